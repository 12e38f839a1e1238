"""Token ids of whole texts, a column at a time.

The ids are those of tokenizers.Tokenizer.encode(text, add_special_tokens=False). For a byte-level BPE whose ids follow
its merge order, a text is cut at every space that stands between two characters that aren't white space: no
pre-token crosses such a place, so each different piece of a batch is encoded once, and the ids of the texts are
gathered with numpy. Texts with other white space around their spaces, or with a special token's string, take the
plain way.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at a time.
SLICE_BYTES = 3_000_000


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest are numbered from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.n_bytes = None
        self.fast = self._fast_bpe(spec)

    @cached_property
    def whole(self):
        """The tokenizer itself, which is read when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _fast_bpe(self, spec: dict):
        """A quicker encoder with the same ids, or None if this vocabulary allows none."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec.get("normalizer") or spec.get("post_processor") or model.get("ignore_merges"):
            return None
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        order = [model["vocab"].get(a + b, -1) for a, b in merges]
        if any(x >= y for x, y in zip(order, order[1:], strict=False)):
            return None
        import public_tokenizers
        import tiktoken

        alphabet = byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        own = {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens", [])}
        self.n_bytes = np.zeros(max([*ranks.values(), *own]) + 1, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        for i, size in own.items():
            self.n_bytes[i] = size
        return tiktoken.Encoding("column", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text."""
        if self.fast is None or any(s in text for s in self.specials):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def columns(self, texts: pa.Array):
        """Yield (first row, ids of the rows end to end, where each row starts) for slices of a string column; nulls count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES)))
            part = texts.slice(at, end - at)
            yield at, *(self._gathered(part) if self.fast is not None else self._one_by_one(part))
            at = end

    def _one_by_one(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.ids(t) for t in part.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.cumsum([0, *map(len, rows)])

    def _gathered(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(part, " ")
        starts = split.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        coded = split.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)
        joined = "".join(" " + w for w, o in zip(words, odd, strict=True) if not o)
        flat = np.asarray(self.fast.encode_to_numpy(joined, disallowed_special=()), np.uint32)
        ends = np.cumsum(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[~odd] + 1)
        cut = np.searchsorted(np.cumsum(self.n_bytes[flat]), ends, side="left") + 1 if len(flat) else np.zeros(0, np.int64)
        size, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[~odd], first[~odd] = np.diff(cut, prepend=0), np.concatenate([[0], cut[:-1]])[: len(cut)]

        n = len(part)
        text_of_piece = np.repeat(np.arange(n), np.diff(starts))
        plain_way = np.zeros(n, bool)
        plain_way[text_of_piece[odd[index]]] = True
        for s in self.specials:
            plain_way |= pc.match_substring(part, s).to_numpy(zero_copy_only=False)
        # the first piece of a text has no space before it; it joins the rare texts in being encoded by itself
        heads, own = starts[:-1], {}
        pieces = index.astype(np.int64)
        lengths = size[pieces]
        lengths[plain_way[text_of_piece]] = 0
        head_words = coded.dictionary.take(coded.indices.take(pa.array(heads))).to_pylist()
        for row, (word, whole) in enumerate(zip(head_words, plain_way, strict=True)):
            own[row] = self.ids(part[row].as_py()) if whole else self.ids(word)
        lengths[heads] = [len(own[r]) for r in range(n)]
        total = np.cumsum(lengths)
        out = np.zeros(int(total[-1]) if len(total) else 0, np.uint32)
        begin = total - lengths
        body = lengths.copy()
        body[heads] = 0
        source = np.repeat(first[pieces], body)
        source += np.arange(len(source)) - np.repeat(np.cumsum(body) - body, body)
        target = np.repeat(begin, body)
        target += np.arange(len(target)) - np.repeat(np.cumsum(body) - body, body)
        out[target] = flat[source]
        for row, ids in own.items():
            out[begin[heads[row]] : begin[heads[row]] + len(ids)] = ids
        return out, np.concatenate([[0], total[starts[1:] - 1]]).astype(np.int64) if n else np.zeros(1, np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder a process."""
    return TextEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
