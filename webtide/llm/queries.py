"""Registered queries of the training-data operators, and their SQL.

Each query applies its operator, with production parameters, to its whole
table and derives the digest columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BytePairs
from .collocations import collocations
from .common import table, whole_text
from .embedding_dedup import near_vectors
from .exact_dedup import exact_duplicates
from .html_extract import extract_main_text
from .langid import identify_languages
from .line_dedup import drop_repeated_lines
from .packing import pack
from .periodic_runs import periodic_runs
from .sharding import shard_rows
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .toxicity import score_toxicity

#: Shards of ``op2``.
SHARDS = 24


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
with digests as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from digests window g as (partition by text_sha256)
"""


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pairs = BytePairs(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = pairs.decode(pairs.encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with recursive u as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)
    and list_contains(list_transform(embedding, lambda x: x <> 0), true)
),
links as (select a.vec_id as a, b.vec_id as b from u a, u b where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select v.vec_id, count(distinct l.b) as n_links, least(v.vec_id, coalesce(min(r.b), v.vec_id)) as component_id,
  v.vec_id = least(v.vec_id, coalesce(min(r.b), v.vec_id)) as kept
from embeddings v left join links l on l.a = v.vec_id left join reach r on r.a = v.vec_id
group by v.vec_id
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3).select("doc_id", "fingerprint", "component_id")


def op6_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op7_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP8_SQL = r"""
with docs as (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select r, unnest(lines) as line, generate_subscripts(lines, 1) as pos from docs),
keys as (
  select r, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
),
frequent as (select key from keys where length(key) >= 1 group by key having count(distinct r) >= 10),
kept as (
  select r, count(*) filter (where key in (select key from frequent)) as n_dropped,
    coalesce(string_agg(line, chr(10) order by pos) filter (where key not in (select key from frequent)), '') as text
  from keys group by r
)
select doc_id, len(lines)::bigint as n_lines, n_dropped, sha256(text) as kept_sha256 from docs join kept using (r)
"""


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n_bytes from documents),
windows as (select doc_id, x, unnest(generate_series(0, n_bytes - 100)) as i from docs where n_bytes >= 100),
keys as (select doc_id, i, md5(substr(x, 2 * i + 1, 200)) as k from windows),
repeats as (select doc_id, i from keys qualify row_number() over (partition by k order by doc_id, i) > 1),
marked as (select doc_id, i, case when i <= 100 + lag(i) over (partition by doc_id order by i) then 0 else 1 end as new from repeats),
numbered as (select doc_id, i, sum(new) over (partition by doc_id order by i rows unbounded preceding) as g from marked),
spans as (select doc_id, min(i) as a, max(i) + 100 as b from numbered group by doc_id, g),
bounds as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from spans),
kept as (
  select doc_id, count(*) as n_spans, sum(b - a)::bigint as n_removed, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) as left_over
  from bounds join docs using (doc_id) group by doc_id
)
select doc_id, n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(left_over, x))) as kept_sha256
from docs left join kept using (doc_id)
"""


def op12_de_bruijn_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), most=5, least=100, percent=100, top=2000)


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
  from documents
),
ws as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
places as (select lang, w, unnest(generate_series(1, len(w))) as i from ws where len(w) > 0),
grams as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as g from places, (values (1), (2), (3), (4), (5)) t(k) where i + k - 1 <= len(w)),
f as (select lang, k, g, count(*) as n from grams group by all),
total as (select lang, sum(n) as total from f where k = 1 group by lang),
candidates as (select * from f where k >= 2 and n >= 100),
free as (
  select * from candidates c where not exists (
    select 1 from candidates d where d.lang = c.lang and d.k > c.k and contains(' ' || d.g || ' ', ' ' || c.g || ' ') and 100 * d.n >= 100 * c.n)
),
cuts as (select lang, k, g, n as a, string_split(g, ' ') as w, unnest(generate_series(1, k - 1)) as cut from free),
scored as (
  select c.lang, c.g, c.a, c.cut, x.n as l, y.n as r, total, (1000 * c.a::hugeint * total::hugeint) // (x.n::hugeint * y.n::hugeint) as score
  from cuts c join f x on x.lang = c.lang and x.g = array_to_string(w[1 : cut], ' ') join f y on y.lang = c.lang and y.g = array_to_string(w[cut + 1 : c.k], ' ')
  join total on total.lang = c.lang
),
best as (select * from scored qualify row_number() over (partition by lang, g order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, g) as rank from best)
select lang, rank, g as phrase, a, l, r, total::bigint as n, score::bigint as score from ranked where rank <= 2000
"""


def op13_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the contract's texts: in a tenth of the documents the words repeat from some word on
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(whole_text("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    a = F.when(n > 0, F.pmod(g, n))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    marked = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumns({"a": a, "p": p})
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    texts = marked.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(texts)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_jump_sharding,
        op3_byte_bpe,
        op4_collision_counting,
        op5_simhash,
        op6_nearest_centroid,
        op7_least_squares_packing,
        op8_line_dedup,
        op9_html_extraction,
        op10_toxic_segments,
        op11_two_stage_suffixes,
        op12_de_bruijn_collocations,
        op13_recompression_runs,
    )
}
SQL = {"op1_exact_dedup": OP1_SQL, "op4_collision_counting": OP4_SQL, "op8_line_dedup": OP8_SQL, "op11_two_stage_suffixes": OP11_SQL, "op12_de_bruijn_collocations": OP12_SQL}
