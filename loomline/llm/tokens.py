"""Public tokenizers behind one interface, loaded once for each Python worker.

A ``.json`` file is read by the tokenizers library and a ``.model`` file by sentencepiece. A byte-level
BPE ``.json`` without normaliser, dropout or word marks, whose merges rank as its ids do, means the same as a
rank table; it then runs on tiktoken's core with the ranks and special tokens taken from that file. The ids are those
of the tokenizers library (tests compare them), at about five times its speed. Texts that the fast core can't take
go to the library itself.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

DEFAULT_FILE = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE files write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_table(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens of a tokenizers file, or None if ranks don't mean the same as its merges."""
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(not t["special"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return None
    letters, vocab, special = _byte_letters(), model["vocab"], {t["content"]: t["id"] for t in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:])):
        return None
    own = {t: i for t, i in vocab.items() if t not in special}
    if len(own) != 256 + len(made) or any(c not in letters for t in own for c in t):
        return None
    return {bytes(letters[c] for c in t): i for t, i in own.items()}, special


class Encoder:
    """encode(texts) gives a list of ids for each text, without begin, end or added special tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.path, self.digest, self._fast, self._special = path, hashlib.sha256(data).hexdigest(), None, {}
        if path.endswith(".model"):
            import sentencepiece

            self._piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocab_size = self._piece.vocab_size()
            return
        from tokenizers import Tokenizer

        self._piece, self._library = None, Tokenizer.from_str(data.decode())
        self._library.no_truncation()
        self._library.no_padding()
        self.vocab_size = self._library.get_vocab_size(with_added_tokens=True)
        if found := rank_table(json.loads(data)):
            import public_tokenizers
            import tiktoken

            ranks, self._special = found
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self._special)

    def by_library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _one(self, text: str) -> list[int]:
        try:
            if any(s in text for s in self._special):
                return self._fast.encode(text, allowed_special="all", disallowed_special=())
            return self._fast.encode_ordinary(text)
        except BaseException as e:  # the core's regex gives up on some very long runs
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
            return self.by_library([text])[0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._piece is not None:
            return self._piece.encode(texts, num_threads=1)
        return [self._one(x) for x in texts] if self._fast else self.by_library(texts)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
