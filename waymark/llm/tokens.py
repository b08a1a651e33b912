"""Ids of public tokenizers at dictionary speed.

Both vocabularies split a text before merging and never merge across the split. Arrow cuts a batch of texts into pieces
whose ids don't depend on their surroundings and numbers the distinct ones; a piece's ids come from the tokenizers library
once, many new pieces in one call, and are then remembered. Texts with white space that Python, Arrow and the library may
class differently go to the library whole, and so do texts that spell out one of the vocabulary's special marks: the library
gives such a mark its own id, as it does by default.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: A mark after one of these letters or digits is a piece of its own in both vocabularies; in that of "lead" a run of any marks
#: of ASCII begins one, but not of an apostrophe, which some endings take with them.
LETTERS, MARKS, LEAD_MARKS = "A-Za-z0-9À-ÖØ-öø-ÿ", ".,;:!?", r"!-&(-/:-@\[-`{-~"
SPLIT = "\x1f"
#: Texts that go to the library whole. "drop": white space carries no ids. "lead": a blank belongs to the word after it, so
#: white space other than single blanks and line ends between words is left to the library.
WHOLE = {"drop": "[\x1c-\x1f]", "lead": "[\x1c-\x1f\t\v\f\r\u0085   -     　]|[ \n][ \n]|^[ \n]|[ \n]$"}


class Pieces:
    """piece -> its ids as little-endian unsigned 32-bit integers, in two generations of bounded size."""

    def __init__(self, path: str, cut: str, special_as_text: bool = False, limit: int = 350_000):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.kind, self.limit = cut, limit
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids  # none where white space carries no ids
        marks = sorted(t.content for t in self.library.get_added_tokens_decoder().values() if t.content)
        self.whole = "|".join([WHOLE[cut], *(f"(?i:{re.escape(m)})" for m in marks)])
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_all(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, encoded joined by line ends and told apart by the line end's id, which no piece has, or else by offsets."""
        joined = "\n".join(pieces)
        if self.kind == "lead" and len(self.line_end) == 1:
            ids = np.asarray(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line_end[0])
            if len(ends) == len(pieces) - 1:
                whole, bounds = ids.tobytes(), (4 * ends).tolist()
                return [whole[a:b] for a, b in zip([0, *(e + 4 for e in bounds)], [*bounds, len(whole)])]
        found = self.library.encode(joined, add_special_tokens=False)
        ids, at = np.asarray(found.ids, "<u4"), np.asarray(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        starts = np.cumsum(sizes) - sizes
        first, last = np.searchsorted(at, starts), np.searchsorted(at, starts + sizes - 1)  # a line end's own id stands at the latter place
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip((4 * first).tolist(), (4 * last).tolist())]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; all are remembered but very long ones."""
        new, old = self.new, self.old
        got = list(map(new.get, pieces))
        asked = []
        for k in [k for k, ids in enumerate(got) if ids is None]:
            p = pieces[k]
            if (ids := old.get(p)) is None:
                if p and not p.isspace() and len(p) <= 1000:
                    asked.append(k)
                    continue
                ids = self.encode(p)
            got[k] = ids
            if len(p) <= 60:
                new[p] = ids
        for k in range(0, len(asked), 2000):
            part = [pieces[j] for j in asked[k : k + 2000]]
            for j, p, ids in zip(asked[k : k + 2000], part, self.encode_all(part)):
                got[j] = ids
                if len(p) <= 60:
                    new[p] = ids
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return got

    def cut(self, texts: pa.Array) -> pa.ListArray:
        if self.kind == "drop":
            apart = pc.replace_substring_regex(pc.ascii_lower(texts), f"([{LETTERS}])([{MARKS}])", r"\1 \2")
            return pc.ascii_split_whitespace(apart)
        apart = pc.replace_substring_regex(texts, f"([{LETTERS}])([{LEAD_MARKS}])", rf"\1{SPLIT}\2")
        apart = pc.replace_substring(pc.replace_substring(apart, " ", f"{SPLIT} "), "\n", f"{SPLIT}\n{SPLIT}")
        return pc.split_pattern(apart, SPLIT)

    def group(self, texts: list[str]) -> list[bytes]:
        arrow = pa.array(texts, pa.string())
        whole = pc.match_substring_regex(arrow, self.whole).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for k in np.flatnonzero(whole).tolist():
            out[k] = self.encode(texts[k])
        rest = np.flatnonzero(~whole)
        if len(rest):
            lists = self.cut(arrow.take(pa.array(rest)))
            ends = lists.offsets.to_numpy()
            flat = lists.flatten().dictionary_encode()
            ids = pa.array(self.learn(flat.dictionary.to_pylist()), pa.large_binary()).take(flat.indices)
            _, until, every = ids.buffers()
            bounds = np.frombuffer(until, np.int64, len(ids) + 1, 8 * ids.offset)[ends - ends[0]].tolist() if len(ids) else [0] * len(ends)
            for k, a, b in zip(rest.tolist(), bounds, bounds[1:]):
                if a < b:
                    out[k] = every[a:b].to_pybytes()
        return out

    def batch(self, texts: list[str | None], chars: int = 1 << 23) -> list[bytes]:
        """Ids of each text; missing and empty ones have none. About `chars` characters are worked on at once."""
        out: list[bytes] = []
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= chars:
                out += self.group(group)
                group, size = [], 0
        return out + self.group(group) if group else out


_KEPT: dict[tuple, Pieces] = {}


def pieces(path: str, cut: str, special_as_text: bool = False, limit: int = 350_000) -> Pieces:
    """One per Python worker."""
    key = (path, cut, special_as_text, limit)
    if key not in _KEPT:
        _KEPT[key] = Pieces(*key)
    return _KEPT[key]
