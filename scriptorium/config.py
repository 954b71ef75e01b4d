"""Frozen options with validation that reports every failure at once."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    mirror_path: str = ""
    store_path: str = ""
    errata_path: str | None = None
    parser: str = "text"
    embedding_model: str = "vocabulary"  # "none" asks for lexical search without vectors
    embedding_dimensions: int = 64
    embedding_batch_size: int = 10
    embedding_concurrency: int = 2
    indexing_parallelism: int = 16
    evidence_budget_chars: int = 16_000
    answer_tokens: int = 1_024
    planner: bool = True
    reranker: bool = True
    vector_only: bool = False
    trace_directory: str | None = None
    sections_per_document: int = 5
    candidate_factor: int = 4
    rrf_constant: int = 60

    def failures(self) -> list[str]:
        checks = [
            (bool(self.store_path.strip()), "store_path must be set"),
            (self.parser in ("text", "xml"), "parser must be text or xml"),
            (bool(self.embedding_model.strip()), "embedding_model must be set"),
            (1 <= self.embedding_batch_size <= 2048, "embedding_batch_size must be from 1 to 2048"),
            (1 <= self.embedding_dimensions <= 16_000, "embedding_dimensions must be from 1 to 16000"),
            (self.embedding_concurrency >= 1, "embedding_concurrency must be positive"),
            (self.indexing_parallelism >= 1, "indexing_parallelism must be positive"),
            (self.evidence_budget_chars >= 1, "evidence_budget_chars must be positive"),
            (self.answer_tokens >= 1, "answer_tokens must be positive"),
            (self.sections_per_document >= 1, "sections_per_document must be positive"),
            (self.candidate_factor >= 1, "candidate_factor must be positive"),
            (self.rrf_constant >= 1, "rrf_constant must be positive"),
        ]
        return [message for good, message in checks if not good]

    def validate(self) -> Options:
        found = self.failures()
        if found:
            raise ValueError("; ".join(found))
        return self
