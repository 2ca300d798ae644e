"""Operator defaults (the reference's service configuration, frozen)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # fixed values: defaults of the reference service
    max_response_bytes: int = 10 * 1024 * 1024  # text fetch cap
    file_max_bytes: int = 25 * 1024 * 1024  # file proxy cap
    max_redirects: int = 7  # fetch and file, config range 0..20
    max_attempts: int = 3  # fetch attempts, at least 1
    page_timeout_secs: int = 60
    fetch_timeout_secs: int = 60  # used when the request has none
    default_page_mode: str = "extractor"
    default_file_mode: str = "auto"
    words_per_minute: int = 200
    retry_after_cap_ms: int = 60_000
    backoff_base_ms: int = 250
    backoff_cap_ms: int = 5_000
    backoff_jitter_ms: int = 200
    allow_loopback: bool = False


DEFAULTS = Limits()
