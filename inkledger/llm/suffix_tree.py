"""Substring dedup by words: remove words covered by a long word sequence that also starts in an earlier document.

Method: prefix-partitioned suffix trees. A task's suffixes are split by variable-length prefixes: a prefix with
more suffixes than ``group`` is extended by a word until its suffixes fit, and neighbouring small prefixes share a
group. Each group's subtree is built from its own suffixes alone, as their sorted order and the depths at which
neighbours part (the intervals of which are the internal nodes); an internal node at window depth or deeper is a
maximal repeat, and its leaves are the repeat's occurrences. A prefix that reaches window depth is itself such a node.
Words are told apart by 64-bit hashes.

Defined cases: null text: no words. Fewer words than a window: kept. A very long text is looked at in stretches of
``repeats.STRIDE`` windows. A null doc_id has no place in the order: such rows keep all words. Rows equal in doc_id
and text are one document. Empty table: empty result. Other columns are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkledger.llm import common as c
from inkledger.llm import repeats as r

WIDTH = 50
GRAM = 8
#: Suffixes of which a subtree is built at once.
GROUP = 1 << 15


def prefix_groups(symbols: np.ndarray, starts: np.ndarray, group: int, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """(suffixes as indices into ``starts``, length of their common prefix), at most ``group`` of them unless they agree in ``most`` symbols."""
    todo = [(np.arange(len(starts)), 0)]
    while todo:
        members, depth = todo.pop()
        if len(members) <= group or depth == most:
            if len(members):
                yield members, depth
            continue
        word = symbols[starts[members] + depth]
        order = np.argsort(word, kind="stable")
        members, word = members[order], word[order]
        edges = np.r_[c.run_starts(word), len(word)].tolist()
        begin = 0
        for a, b in zip(edges, edges[1:]):
            if b - begin > group and a > begin:  # neighbouring small prefixes share a group
                yield members[begin:a], depth
                begin = a
            if b - a > group:
                todo.append((members[a:b], depth + 1))
                begin = b
        if begin < len(members):
            yield members[begin:], depth


def deep_nodes(symbols: np.ndarray, starts: np.ndarray, members: np.ndarray, depth: int, width: int) -> Iterator[np.ndarray]:
    """Leaves of each highest internal node of ``width`` or deeper in the subtree of the suffixes ``members``, which agree in ``depth`` symbols."""
    if depth >= width:
        if len(members) > 1:
            yield members
        return
    steps = range(depth, width)
    order, common = r.sort_windows(symbols, starts[members], steps)
    inside = np.r_[common == len(steps), False]
    opens = np.flatnonzero(inside[1:] & ~inside[:-1])
    closes = np.flatnonzero(~inside[1:] & inside[:-1])
    for a, b in zip(opens, closes):
        yield members[order[a : b + 1]]


def _index(scheme: r.Scheme, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(r.pieces(batches, scheme, 1 << 62))
        if not found:
            return
        p = found[0]
        seg, offset = p.windows()
        starts = p.starts[seg] + offset
        doc = p.cols["doc"][seg]
        gone = np.zeros(len(starts), bool)
        for members, depth in prefix_groups(p.symbols, starts, group, scheme.width):
            for leaves in deep_nodes(p.symbols, starts, members, depth, scheme.width):
                gone[leaves] = doc[leaves] > doc[leaves].min()
        seg, offset = seg[gone], offset[gone]
        yield from r.marks_of(doc[gone], p.cols["ver"][seg], p.cols["pos"][seg].astype(np.int64) + offset)

    return run


def repeated_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, ver, spans) of documents with words to remove; ``docs`` as of ``docs_with_version``."""
    scheme = r.Scheme("words", width, gram, True)
    return r.repeated_windows(docs.where("doc_id is not null"), scheme, _index(scheme, group), "suffix-tree")


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, hashes = [], [], []
            texts, spans = batch.column("text").cast(pa.large_binary()), batch.column("spans")
            for text, span in zip(texts, spans):
                words = (text.as_py() or b"").split()
                starts, ends = r.covered(span, width)
                n_words.append(len(words))
                if len(starts):
                    edges = np.r_[0, np.c_[starts, ends].ravel(), len(words)].tolist()
                    words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                n_removed.append(n_words[-1] - len(words))
                hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(hashes, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    base = c.docs_with_version(docs)
    spans = repeated_words(base, width, gram, group)
    return base.join(spans.hint("shuffle_hash"), ["doc_id", "ver"], "left").mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")
