"""Deterministic stand-ins for user models, used by tests and the registered
queries: the reference plugs in a hosted embedder / LLM; here a model is just
a callable on a batch of strings.  Both are small per-batch helpers."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np
import xxhash

_WORD = re.compile(r"\w+", re.UNICODE)


def hashing_embedder(dim: int = 16, seed: int = 0):
    """Feature-hashing bag-of-words embedder, L2-normalised: ``list[str] -> list[list[float]]``."""
    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for r, t in enumerate(texts):
            for w in _WORD.findall((t or "").lower()):
                h = xxhash.xxh64_intdigest(w, seed)
                out[r, h % dim] += 1.0 if (h >> 63) == 0 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        n[n == 0] = 1.0
        return (out / n).tolist()
    return embed


def letter_embedder(letters: str):
    """How often each letter occurs, in thousands: a vector that SQL can check."""
    def embed(texts: Sequence[str]) -> list[list[float]]:
        return [[(t or "").count(c) / 1000 for c in letters] for t in texts]
    return embed


# Cue words per label of the keyword scorer (one short list each).
LANGUAGE_CUES = {
    "en": ("the", "and", "of", "with", "is"),
    "fr": ("le", "la", "des", "et", "une"),
    "de": ("die", "der", "und", "in", "von"),
    "es": ("el", "los", "del", "y", "que"),
}


def keyword_llm(cues: dict[str, Sequence[str]] = LANGUAGE_CUES, fence_every: int = 7,
                junk_every: int = 23):
    """A stand-in "LLM": scores each label by the share of its cue words in the
    prompt and answers with a JSON object; some answers are fenced and some are
    not JSON at all, so the parsing / error paths run too."""
    labels = list(cues)

    def call(prompts: Sequence[str]) -> list[str]:
        out = []
        for p in prompts:
            words = _WORD.findall((p or "").lower())
            counts = np.array([sum(words.count(c) for c in cues[k]) for k in labels], dtype=float)
            tot = counts.sum()
            probs = counts / tot if tot > 0 else np.full(len(labels), 1.0 / len(labels))
            scores = {k: round(float(v), 4) for k, v in zip(labels, probs)}
            body = json.dumps({"predicted_label": labels[int(np.argmax(probs))],
                               "confidence": max(scores.values()), "scores": scores})
            n = len(p or "")
            if junk_every and n % junk_every == 0:
                out.append("I cannot classify this.")
            elif fence_every and n % fence_every == 0:
                out.append("```json\n" + body + "\n```")
            else:
                out.append(body)
        return out
    return call
