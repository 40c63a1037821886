from __future__ import annotations

WORDS = ["alpha", "beta", "Gamma", "délta", "日本", "x", "y2", "omega", "the", "of", "and", "to", "moron,", "1.5", "q-r", "É"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(texts, start=0, source=lambda i: f"src{i % 3}"):
    return [(start + i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)]
