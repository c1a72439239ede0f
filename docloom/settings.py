"""Tunables shared by every operator, held in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Fixed values that results depend on.
    ocr_text_threshold: int = 50
    chunk_target_tokens: int = 450
    chunk_max_tokens: int = 500
    chunk_overlap_ratio: float = 0.12
    embed_dim: int = 1024
    minhash_perm: int = 128
    minhash_bands: int = 32
    near_dup_jaccard: float = 0.8
    semantic_dup_threshold: float = 0.95
    tag_similarity_threshold: float = 0.55
    title_llm_threshold: float = 0.6
    llm_title_confidence: float = 0.7
    tree_small_doc_chunks: int = 8
    tree_max_depth: int = 3
    tree_max_clusters: int = 8
    rrf_k: int = 60
    knn_k: int = 50
    bm25_size: int = 50
    superseded_penalty: float = 0.7
    snippet_chars: int = 240
    highlight_chars: int = 180
    quote_chars: int = 300
    ask_top_k: int = 8
    suggest_min_chars: int = 2
    suggest_documents: int = 8
    suggest_tags: int = 5
    job_max_attempts: int = 3
    reenrich_added_fraction: float = 0.2
    history_turns: int = 6
    enrichment_sample_chars: int = 6000
    summary_input_chars: int = 12000
    # Published BM25 defaults.
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    # Physical limits: what may be shipped to every task, and block sizes.
    broadcast_query_rows: int = 200_000
    broadcast_query_bytes: int = 64 * 1024 * 1024
    grid_cell_rows: int = 20_000
    dedup_block_rows: int = 512
    hot_key_share: int = 1000


DEFAULTS = Settings()
