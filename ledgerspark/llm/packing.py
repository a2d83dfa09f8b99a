"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document longer than the window is cut into full windows and a rest. The rest goes to the fill level that minimises
the sum of squared counts of partially filled windows per level (Csirik et al., "sum of squares"); the counts are kept
in a level array, and windows of a level in a stack. Each input partition packs its own stream, so nothing is shuffled
and memory holds only open windows. At the end of a partition the emptiest open windows are cut up to fill the fullest
ones, which leaves one partial window at most per partition.

Null and empty texts are documents of one end token. A very long text is tokenised whole and cut into full windows and a rest.
Rows with equal ids are packed each by itself. No rows in, none out.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded_batches, trim

#: (document index, start in it, length)
Piece = tuple[int, int, int]


class SumOfSquares:
    """Open windows by fill level. ``add`` yields the windows that become full, ``drain`` the rest."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.full: list[list[Piece]] = []

    def add(self, doc: int, n: int) -> None:
        w, start = self.window, 0
        while n - start >= w:
            self.full.append([(doc, start, w)])
            start += w
        if n > start:
            self._place((doc, start, n - start))

    def _place(self, piece: Piece) -> None:
        n, w, c = piece[2], self.window, self.count
        # Change of the sum of squares for each level h: one window less at h, one more at h + n (none if full).
        gain = np.zeros(w - n + 1, dtype=np.int64)
        gain[: w - n] = 2 * c[n:w] + 1
        gain[1:] += 1 - 2 * c[1 : w - n + 1]
        gain[1:][c[1 : w - n + 1] == 0] = np.iinfo(np.int64).max
        h = int(gain.argmin())
        bin_ = self.open[h].pop() if h else []
        c[h] -= h > 0
        bin_.append(piece)
        if h + n == w:
            self.full.append(bin_)
        else:
            c[h + n] += 1
            self.open.setdefault(h + n, []).append(bin_)

    def drain(self) -> None:
        w = self.window
        left = [(h, b) for h in sorted(self.open) for b in self.open[h]]
        self.open, self.count = {}, np.zeros(w + 1, dtype=np.int64)
        lo, hi = 0, len(left) - 1
        spare: list[Piece] = []
        while hi >= lo:
            h, b = left[hi]
            hi -= 1
            while h < w and (spare or lo <= hi):
                if not spare:
                    spare = left[lo][1]
                    lo += 1
                doc, start, n = spare.pop()
                take = min(n, w - h)
                b.append((doc, start, take))
                h += take
                if take < n:
                    spare.append((doc, start + take, n - take))
            self.full.append(b)
        for k in range(0, len(spare)):
            n = spare[k][2]
            last = self.full[-1] if k and sum(p[2] for p in self.full[-1]) + n <= w else None
            if last is None:
                self.full.append([spare[k]])
            else:
                last.append(spare[k])


#: What a file must state for its words to be encoded apart from each other, and for the split of words below. Fixed values.
WORD_RULES = (
    [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)],
    [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)],
)
#: Letters that the normaliser maps to one letter each, and ASCII marks other than the apostrophe, which begins contractions.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"


def word_wise(path: str) -> bool:
    """Whether the tokenizer in ``path`` follows ``WORD_RULES`` and ends words with a mark of their own."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    rule = lambda x: (x.get("type"), (x.get("pattern") or {}).get("Regex"))
    found = tuple([rule(x) for x in (d.get(part) or {}).get(items, [])] for part, items in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    split = ((d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    model, specials = d["model"], d.get("added_tokens") or []
    # A special token with white space inside is met by the whole text only, not by its words.
    plain = all(len(x["content"].split()) == 1 and "|" in x["content"][1:] and x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["normalized"] or x["single_word"]) for x in specials)
    return found == WORD_RULES and split.get("behavior") == "Removed" and split.get("invert") and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("unk_token") and plain


class WordCachedTokenizer:
    """Ids of whole texts, as the tokenizer gives them. Words between ASCII white space are encoded once each.

    Its normaliser and splitter act inside runs of non-space only, so the ids of a text are those of its words in a row.
    It also lower-cases, and a word of letters followed by marks splits between the two, so such words share the
    encoding of their parts. Letters are those of Latin-1, whose lower case is one letter; all other words are encoded
    plainly, as they are, and so are texts of a file with other rules. The cache holds ``most`` parts; beyond, it goes
    back to those met first.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok, self.most, self.word_wise = Tokenizer.from_file(path), most, word_wise(path)
        # Ids that end a run of letters, so that many such runs can be encoded in one call and told apart again.
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.parts: dict[str, int] = {"": 0}
        self.untrimmed = 0
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.start, self.length = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _halve(self) -> None:
        """Forgets the parts that were met last; frequent ones are met first."""
        kept = list(itertools.islice(self.parts, 1, self.most // 2))
        self._clear()
        self._numbers(pa.array(kept, pa.string()))

    def _add(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Stores runs of ids; returns where each begins."""
        at = self.size + np.cumsum(length) - length
        self.ids.append(ids)
        self.size += len(ids)
        return at

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """Numbers of different ``parts``; new ones are encoded."""
        keys = parts.to_pylist()
        found = list(map(self.parts.get, keys))
        at = [k for k, x in enumerate(found) if x is None]
        if at:
            new = [keys[k] for k in at]
            first = len(self.parts)
            self.parts.update(zip(new, range(first, first + len(new)), strict=True))
            for n, k in enumerate(at, first):
                found[k] = n
            plain = pc.match_substring_regex(pa.array(new, pa.string()), f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
            letters, rest = list(itertools.compress(new, plain)), list(itertools.compress(new, ~plain))
            start, length = np.zeros(len(new), dtype=np.int64), np.zeros(len(new), dtype=np.int64)
            if letters:
                ids = np.array(self.tok.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, dtype="<u4")
                length[plain] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
                start[plain] = self._add(ids, length[plain])
            if rest:
                ids = [e.ids for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
                length[~plain] = list(map(len, ids))
                start[~plain] = self._add(np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4"), length[~plain])
            self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
            self.ids = [np.concatenate(self.ids)]
            self.untrimmed += len(new)
            if self.untrimmed > 100_000:
                self.untrimmed = 0
                trim()
        return np.array(found, dtype=np.int64)

    def _halves(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the letters and of the marks after them, for each of ``words``."""
        cut = pc.extract_regex(words, f"^(?P<a>[{LETTERS}]+)(?P<b>[{MARKS}]*)$")
        split = cut.is_valid()
        a = pc.if_else(split, pc.utf8_lower(cut.field("a")), words)
        b = pc.if_else(split, cut.field("b"), "")
        out = []
        for part in (a, b):
            d = part.dictionary_encode()
            out.append(self._numbers(d.dictionary)[d.indices.to_numpy()])
        return out[0], out[1]

    def __call__(self, texts: pa.Array, at_once: int = 4 << 20) -> Iterator[np.ndarray]:
        """Ids of each of ``texts`` (null: empty)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.word_wise:
            for t in texts:
                yield np.array(self.tok.encode(t.as_py(), add_special_tokens=False).ids, dtype="<u4")
            return
        total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + at_once, side="right")))
            if len(self.parts) > self.most:
                self._halve()
            lists = pc.ascii_split_whitespace(texts.slice(at, stop - at))
            words = lists.flatten().dictionary_encode()
            a, b = self._halves(words.dictionary.cast(pa.string()))
            # Ids of the different words, then those of the texts.
            both = np.stack([a, b], axis=1).ravel()
            table = (self.ids[0] if self.ids else np.zeros(0, dtype="<u4"))[runs(self.start[both], self.length[both])]
            n = self.length[a] + self.length[b]
            use = words.indices.to_numpy()
            flat = table[runs((np.cumsum(n) - n)[use], n[use])]
            ends = np.concatenate(([0], np.cumsum(n[use])))[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
            yield from np.split(flat, ends[:-1])
            at = stop


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the next run."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece (``SCHEMA``). ``docs`` needs ``doc_id`` and ``text``; other columns are left out of the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = WordCachedTokenizer(tokenizer_path), SumOfSquares(window)
        part, made, docs_in = TaskContext.get().partitionId(), 0, 0
        held: dict[int, list] = {}  # document index: id, ids, tokens not written yet
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def rows() -> pa.RecordBatch:
            nonlocal made
            out = []
            for seq in packer.full:
                at = 0
                for doc, start, n in seq:
                    entry = held[doc]
                    ids = entry[1]
                    out.append((entry[0], start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), (part << 40) + made, at))
                    at += n
                    entry[2] -= n
                    if not entry[2]:
                        del held[doc]
                made += 1
            packer.full = []
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=names)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.array([end_id], dtype="<u4"))
                held[docs_in] = [doc_id, ids, len(ids)]
                packer.add(docs_in, len(ids))
                docs_in += 1
                if len(packer.full) >= 256:
                    yield rows()
        packer.drain()
        yield rows()
        # The worker lives on for other tasks: give the memory of the words back.
        del encode
        trim()

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
