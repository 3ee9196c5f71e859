"""Parameters of the crawl index, with presets for production and for small tests."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    """Fixed values that results depend on."""

    index_cap: int = 100_000  # documents per shard
    shard_size: int = 100_000  # scale of document frequencies
    max_document_len: int = 256_000  # bytes of a page that a fetch reads
    max_url_len: int = 250
    max_robots_len: int = 256_000  # bytes; the legacy crawler ignores longer files
    min_n_tokens: int = 200
    min_log2_terms: int = 8  # shorter documents are no search results
    top_k: int = 20
    n_queues: int = 64
    page_capacity: int = 60
    min_run_len: int = 32
    work_queue_cap: int = 250  # jobs that wait for a worker
    work_empty_threshold: int = 10  # fewer waiting jobs make a worker idle
    cross_domain_bonus: int = 1
    article_terms: int = 30
    print_prob: float = 0.002
    n_cores: int = 4
    root: str = ""


PROD = Config()
DEBUG = replace(PROD, index_cap=100, n_queues=4)
LEGACY = replace(PROD, min_n_tokens=0, max_url_len=300, index_cap=300_000)


def load_config(debug: bool = False) -> Config:
    """The preset, rooted at the folder in CRAWLER_DIR."""
    return replace(DEBUG if debug else PROD, root=os.environ.get("CRAWLER_DIR", ""))
