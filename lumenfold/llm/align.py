"""Alignment of the tokens of two tokenizers over the same text.

Tokenizer A is byte-level BPE (``tokenizers`` JSON), tokenizer B a sentence-piece model. A reads a space and the
text; B adds that space itself. Both token lists spell the same bytes; the ends of their tokens, as bytes from the
start, go into one dictionary each (end -> index), the keys of both are intersected as sets, and the sorted common
ends slice both id lists into groups. Within a group an A and a B token are linked if their bytes overlap.

A text is cut at every single space between two characters that aren't white space. There both tokenizers start
anew (A's pattern begins a pre-token; no piece of B goes on over a space, which ``Aligner`` verifies), so a
cut is a common end, and what is between two cuts is aligned on its own. Parts repeat, so a bounded number of
them is remembered. A very long text is read in sections that end at a cut, so that memory holds one
section and the text's distinct linked pairs; a text without a cut is one part.

How many documents hold a pair linked is counted over all documents. Documents come in blocks of about ``BLOCK``
pairs, and a block asks for the count of each of its distinct pairs once, however many of its documents hold
it: a pair that all documents hold is one row of each block, and nothing that grows with the corpus is broadcast.

Nulls: a null or empty text, and one that A or B don't spell as a space and the text (as with U+2581), has no
tokens: zeros and an empty hash. Special tokens inside texts are plain text. Null ids are kept. Repeated rows
count as documents each. Several pairs of an A id that are equally frequent are all its best. Empty table: empty result. Other
columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Characters of a section and of the sections that are worked on together, number of parts that are remembered, pairs of a block.
SECTION, SLICE, REMEMBERED, BLOCK = 1 << 18, 1 << 20, 1 << 18, 1 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
UNEVEN = re.compile(r"[^\S ]|  |\A | \Z")  # white space that isn't one space between two characters
#: Parts of these characters only are told apart alike by all libraries; others go through the tokenizer's own.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u017f]*")
#: The pre-tokens of byte-level BPE (fixed, published pattern).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
FOUND = "block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: visible Latin-1 characters stand for themselves, the other bytes for 256 and on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    if m := re.fullmatch(r"<0x([0-9A-F]{2})>", piece):
        return bytes([int(m[1], 16)])
    return piece.replace(SPACE, " ").encode()


def align(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray) -> tuple[list[int], list[str], np.ndarray, np.ndarray]:
    """(common ends, groups as text, link ends, links as a << 32 | b) of two token lists over the same bytes, from their ends.

    A stretch between two neighbouring ends of either list lies in one token of each, and two tokens that overlap share just
    one stretch: within a slice each stretch is a link, and it ends where the link is counted.
    """
    a_at, b_at = dict(zip(a_ends.tolist(), count(1))), dict(zip(b_ends.tolist(), count(1)))
    common = sorted(a_at.keys() & b_at.keys())
    groups, i, j, a_text, b_text = [], 0, 0, list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
    for end in common:
        i2, j2 = a_at[end], b_at[end]
        groups.append(a_text[i] + "|" + b_text[j] if i2 - i == j2 - j == 1 else ",".join(a_text[i:i2]) + "|" + ",".join(b_text[j:j2]))
        i, j = i2, j2
    ends = np.union1d(a_ends, b_ends)
    return common, groups, ends, a_ids[np.searchsorted(a_ends, ends)] << 32 | b_ids[np.searchsorted(b_ends, ends)]


class Aligner:
    """Two tokenizers and what is remembered of parts; each Python worker builds one.

    A part has a code, and under it stand its counts, its groups as text and its links, so that a text is an array of
    codes and what is gathered from it comes by sums over arrays.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, self.a_bytes = byte_letters(), [b""] * (max(model["vocab"].values()) + 1)
        for entry, i in model["vocab"].items():
            self.a_bytes[i] = bytes(letters[c] for c in entry)
        self.a_fast = self._ranks(model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece goes on over a space: texts can't be cut there")
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), "i8") for x in (self.a_bytes, self.b_bytes))
        self._forget()

    def _ranks(self, model: dict):
        """A's merges for a quicker library, where they come in the order of their ids, so that the ids are ranks; else None."""
        import tiktoken

        vocab, merges = model["vocab"], (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        made = [vocab[x + y] for x, y in merges]
        if made != sorted(made) or self.a.pre_tokenizer is None or "use_regex=True" not in repr(self.a.pre_tokenizer):
            return None
        ranks = {self.a_bytes[i]: i for i in vocab.values()}
        return tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: not spelt by both
        self.counts = array("q")  # n_a, n_b, n_groups, n_links of each code
        self.links, self.starts, self.chars = array("q"), array("q", [0]), 0

    def _learn(self, new: list[str]) -> None:
        """Codes for new parts, of which each begins after a cut: their tokens are laid end to end and aligned at once."""
        text, plain = " " + " ".join(new), self.a_fast is not None and all(map(PLAIN.fullmatch, new))
        a = self.a_fast.encode_ordinary(text) if plain else list(chain.from_iterable(e.ids for e in self.a.encode_batch([" " + p for p in new], add_special_tokens=False)))
        b = list(chain.from_iterable(self.b.encode(new, num_threads=1)))
        spelt = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != spelt or b"".join(map(self.b_bytes.__getitem__, b)) != spelt:
            if len(new) > 1:
                self._learn(new[: len(new) // 2])
                return self._learn(new[len(new) // 2 :])
            return self._add(new, [None], np.zeros((1, 4), "i8"), np.zeros(0, "i8"))
        a, b = np.array(a, "i8"), np.array(b, "i8")
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        common, groups, link_ends, links = align(a, a_ends, b, b_ends)
        part_ends = np.cumsum([1 + len(p.encode()) for p in new])
        borders = np.stack([np.searchsorted(ends, part_ends, "right") for ends in (a_ends, b_ends, common, link_ends)], axis=1)
        at = [0, *borders[:, 2].tolist()]
        self._add(new, [";".join(groups[i:j]) for i, j in zip(at, at[1:])], np.diff(borders, axis=0, prepend=0), links)

    def _add(self, new: list[str], groups: list[str | None], counts: np.ndarray, links: np.ndarray) -> None:
        self.known.update(zip(new, count(len(self.groups))))
        self.groups += groups
        self.counts.frombytes(counts.tobytes())
        self.starts.frombytes((self.starts[-1] + np.cumsum(counts[:, 3])).tobytes())
        self.links.frombytes(links.tobytes())
        self.chars += sum(map(len, new))

    def codes(self, parts: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(p for p in parts if p not in self.known))
        for some in ([p for p in new if PLAIN.fullmatch(p)], [p for p in new if not PLAIN.fullmatch(p)]):
            for i in range(0, len(some), 4096):
                self._learn(some[i : i + 4096])
        return np.fromiter(map(self.known.__getitem__, parts), "i8", len(parts))

    def _gather(self, some: list[str]) -> Iterator[tuple[np.ndarray | None, str, np.ndarray, np.ndarray]]:
        """For each of some sections: its four counts (None: not spelt), its groups, its distinct links and how often each occurs."""
        if len(self.known) > REMEMBERED or self.chars > 64 * REMEMBERED:
            self._forget()
        parts = [cut_parts(section) for section in some]
        sizes = np.fromiter(map(len, parts), "i8", len(parts))
        codes = self.codes(list(chain.from_iterable(parts)))
        ends = np.cumsum(sizes)
        counts, links, starts = np.array(self.counts, "i8").reshape(-1, 4), np.array(self.links, "i8"), np.array(self.starts, "i8")
        # each section's distinct codes, then their links laid side by side, then the distinct ones of these
        keys, times = np.unique(np.repeat(np.arange(len(parts)), sizes) * len(counts) + codes, return_counts=True)
        section, code = keys // len(counts), keys % len(counts)
        n = starts[code + 1] - starts[code]
        at = np.repeat(starts[code] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        pair, section, times = links[at], np.repeat(section, n), np.repeat(times, n)
        order = np.lexsort((pair, section))
        pair, section, times = pair[order], section[order], times[order]
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (section[1:] != section[:-1]))) if len(pair) else np.zeros(0, "i8")
        times = np.add.reduceat(times, first) if len(first) else times
        pair, borders = pair[first], np.searchsorted(section[first], np.arange(len(parts) + 1))
        for k in range(len(parts)):
            own = codes[ends[k] - sizes[k] : ends[k]]
            texts = list(map(self.groups.__getitem__, own.tolist()))
            spelt = None not in texts
            yield counts[own].sum(axis=0) if spelt else None, ";".join(texts) if spelt else "", pair[borders[k] : borders[k + 1]], times[borders[k] : borders[k + 1]]

    def texts(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """For each text n_a, n_b, n_groups, n_links, groups_sha256, its distinct links (a << 32 | b) and how often each occurs."""
        nothing = np.zeros(0, "i8")

        def found() -> tuple:
            if total is None or not total[0]:
                return 0, 0, 0, 0, "", nothing, nothing
            pair, n = pairs[0], times[0]
            if len(pairs) > 1:
                pair, where = np.unique(np.concatenate(pairs), return_inverse=True)
                n = np.bincount(where, np.concatenate(times)).astype("i8")
            return *map(int, total), digest.hexdigest(), pair, n

        total, digest, pairs, times = np.zeros(4, "i8"), hashlib.sha256(), [], []
        for some in slices_of(texts):
            for (_, last), (counts, groups, pair, n) in zip(some, self._gather([section for section, _ in some])):
                if counts is None or total is None:
                    total, pairs, times = None, [], []
                else:
                    digest.update((";" * bool(total[2]) + groups).encode())
                    total = total + counts
                    pairs.append(pair)
                    times.append(n)
                if last:
                    yield found()
                    total, digest, pairs, times = np.zeros(4, "i8"), hashlib.sha256(), [], []


def cut_parts(section: str) -> list[str]:
    """The parts between the cuts of a section."""
    return CUT.split(section) if UNEVEN.search(section) else section.split(" ")


def slices_of(texts: Iterable[str | None]) -> Iterator[list[tuple[str, bool]]]:
    """(section, whether it is its text's last) of all texts in order, some at a time; an empty text is one empty section."""
    some, chars = [], 0
    for text in texts:
        held = None
        for section in sections(text or ""):
            if held is not None:
                some.append((held, False))
            held = section
            chars += len(section)
            if chars >= SLICE and some:
                yield some
                some, chars = [], len(section)
        some.append((held or "", True))
    if some:
        yield some


def sections(text: str, chars: int = SECTION) -> Iterator[str]:
    """The text in sections that end at the first cut after so many characters."""
    start = 0
    while start < len(text):
        cut = CUT.search(text, start + chars)
        yield text[start : cut.start() if cut else len(text)]
        start = cut.end() if cut else len(text)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _of_docs(rows: Iterator[pa.RecordBatch], a_path: str, b_path: str, most: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to FOUND; a block is a task's next documents with about so many pairs."""
    from pyspark import TaskContext

    both = aligner(a_path, b_path)
    gc.disable()  # what is remembered has no cycles, and looking for some takes an eighth of the time
    block, full, out, held = TaskContext.get().partitionId() << 32, 0, [], 0
    schema = pa.schema([(n, pa.int64()) for n in ("block", "id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    for some in rows:
        for i, (*counts, pairs, times) in zip(some.column(0), both.texts(t.as_py() for t in some.column(1))):
            if full and full + len(pairs) > most:
                block, full = block + 1, 0
            out.append((block, i.as_py(), *counts, pairs, times))
            full, held = full + len(pairs), held + len(pairs)
            if held > most // 8 or len(out) >= 4096:
                yield batch()
                out, held = [], 0
    gc.enable()
    if out:
        yield batch()


def _counted(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents and the (pair, n, best) of its pairs: n_best and count_sum are added."""
    order = np.argsort(pair := counts.column("pair").to_numpy())
    pair, n, best = pair[order], counts.column("n").to_numpy()[order], counts.column("best").to_numpy().astype("i8")[order]
    sums = {"n_best": [], "count_sum": []}
    for chunk in docs.select(["pairs", "times"]).to_batches():
        lists = chunk.column(0)
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        times = chunk.column(1).flatten().to_numpy()
        for name, values in (("n_best", best), ("count_sum", n)):
            total = np.append(0, np.cumsum(times * values[at])) if len(at) else np.zeros(1, "i8")
            sums[name].append(total[ends[1:]] - total[ends[:-1]])
    out = docs.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    for name, found in sums.items():
        out = out.append_column(name, pa.array(np.concatenate([np.zeros(0, "i8"), *found])))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def align_texts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = written(rows.mapInArrow(lambda some: _of_docs(some, a_path, b_path, block), FOUND))
    counts = written(pair_counts(found))
    asked = found.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).distinct().join(counts, "pair")
    schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return found.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(_counted, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): the number of documents that hold a pair linked, and whether no pair of the same A id has more."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    # one row for each id of A's vocabulary at most
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a"))
    return counts.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
