"""Alignment of two tokenizers over a corpus, each distinct text once.

Rows are shuffled by their full text and counted; every distinct text is tokenized and aligned once and stands for all
its copies.  A text is cut where neither tokenizer ever joins what is before and after; the alignment of such a chunk
never depends on its neighbours, so a worker aligns a chunk once and texts are put together from chunks.

Two tokens are linked where they end at the same byte.  One of them is then a suffix of the other, so there are at
most as many different pairs as the entries of both vocabularies have suffixes, whatever the size of the corpus: the
table of counts is bounded by the vocabularies (about half a million rows) and may be broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklog.llm.common import held_by_worker, through_table
from brooklog.llm.flat_ids import BETWEEN_WORDS, CACHE_CHUNKS, Chunks, FlatByteIds, Grown, between_classes, flat, ragged, text_slices

#: Copies from which a text counts as hot: at least so many, and so many that hot texts are at most ``HOT_TEXTS``.
HOT_COPIES, HOT_TEXTS = 10_000, 100_000
#: Bytes of groups that the broadcast of hot texts may hold; above it they are joined as all others.
HOT_BYTES = 32_000_000
#: Links that are looked at in one go (those of one longer text are looked at together).
SLICE_LINKS = 1_000_000

TEXTS = "blob binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of byte-level vocabularies stands for: printable ones themselves, others from 256 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenBytes:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def same(self, ids: np.ndarray, counts: np.ndarray, chunks: list[bytes]) -> np.ndarray:
        """For each chunk, whether its ids (``counts`` of them) stand for just its bytes."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        at = np.concatenate([[0], np.cumsum(counts)])
        data = self.data[ragged(self.lengths[ids], self.starts[ids])].tobytes()
        cuts = ends[at].tolist()
        return np.array([data[a:b] == c for a, b, c in zip(cuts, cuts[1:], chunks, strict=False)], bool)


class PieceIds:
    """Ids of chunks by a sentencepiece model that keeps line feeds apart and opens every text with a space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        own = [not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)) for i in range(len(pieces))]
        written = [p for p, o in zip(pieces, own, strict=True) if o]
        self.bytes = [p.replace("▁", " ").encode() if o else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" for i, (p, o) in enumerate(zip(pieces, own, strict=True))]
        self.lead = len(self.model.encode("\n"))
        if any("\n" in p or re.search("[^▁]▁", p) for p in written) or self.lead != 2 or self.model.encode("a  b\n c", out_type=str)[0][0] != "▁":
            raise ValueError("the model joins line feeds or words, or opens no text with a space")
        #: (last byte, next byte): whether no piece holds the two side by side.
        self.apart = np.ones((256, 256), bool)
        for p in written:
            data = np.frombuffer(p.replace("▁", " ").encode(), np.uint8)
            self.apart[data[:-1], data[1:]] = False

    def new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks in a row, and how many each has; a line feed before each takes the opening space along."""
        found = self.model.encode(["\n" + c for c in chunks], num_threads=1)
        return np.array([i for ids in found for i in ids[self.lead :]], np.int64), np.array([len(ids) - self.lead for ids in found], np.int64)


class Aligner(Chunks):
    """Tokens, groups and links of chunks by a byte-level BPE file (A) and a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.b = PieceIds(b_path)
        between = between_classes() & self.b.apart
        self.a = FlatByteIds(a_path, plain_specials=True, first=BETWEEN_WORDS, between=between)
        alphabet = byte_alphabet()
        vocabulary = self.a.tokenizer.get_vocab()
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            entries[i] = bytes(alphabet[c] for c in entry) if entry not in self.a.specials else entry.encode()
        self.a_bytes, self.b_bytes = TokenBytes(entries), TokenBytes(self.b.bytes)
        self.n_b = len(self.b.bytes)
        self.link_type = np.dtype("<u4" if len(entries) * self.n_b <= 2**32 else "<i8")
        self.a_names, self.b_names = [str(i) for i in range(len(entries))], [str(i) for i in range(self.n_b)]
        super().__init__(BETWEEN_WORDS, None, between)

    def clear(self) -> None:
        super().clear()
        self.tokens_a, self.tokens_b, self.n_groups, self.differs = Grown(np.int64), Grown(np.int64), Grown(np.int64), Grown(np.int64)
        self.links, self.first_link = Grown(np.int64), Grown(np.int64)
        self.groups: list[str] = []

    def full(self) -> bool:
        return len(self.number) > CACHE_CHUNKS // 2

    def learn(self, chunks: list[str]) -> None:
        """Align chunks; one whose tokens of either kind are not its bytes has none and is marked."""
        raw = [c.encode() for c in chunks]
        (a, count_a), (b, count_b) = self.a.new(chunks), self.b.new(chunks)
        same = self.a_bytes.same(a, count_a, raw) & self.b_bytes.same(b, count_b, raw)
        a, b = a[np.repeat(same, count_a)].astype(np.int64), b[np.repeat(same, count_b)]
        count_a, count_b = np.where(same, count_a, 0), np.where(same, count_b, 0)
        ends_a, ends_b = np.cumsum(self.a_bytes.lengths[a]), np.cumsum(self.b_bytes.lengths[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        # Both tokenizers part at the ends of chunks, so these are among the common ends.
        done = np.searchsorted(at_a, np.cumsum(count_a) - 1, "right") * (len(a) > 0)
        done = np.maximum.accumulate(np.where(same, done, 0)) if len(done) else done
        n_groups = np.diff(done, prepend=0)
        names_a, names_b = [self.a_names[i] for i in a.tolist()], [self.b_names[i] for i in b.tolist()]
        texts, x, y = [], 0, 0
        for p, q in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            texts.append(f"{','.join(names_a[x:p])}|{','.join(names_b[y:q])}")
            x, y = p, q
        bounds = [0, *done.tolist()]
        self.groups += [";".join(texts[s:t]) for s, t in zip(bounds, bounds[1:], strict=False)]
        self.first_link.add(self.links.size + done - n_groups)
        self.links.add(a[at_a] * self.n_b + b[at_b])
        for grown, values in ((self.tokens_a, count_a), (self.tokens_b, count_b), (self.n_groups, n_groups), (self.differs, ~same)):
            grown.add(values.astype(np.int64))

    def align(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Measures, groups and links of texts, each given with a space before it."""
        codes, bounds = self.codes(texts)

        def total(grown: Grown) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(grown.held[codes])])
            return sums[bounds[1:]] - sums[bounds[:-1]]

        _, at = flat(texts)
        none = (total(self.differs) > 0) | (np.diff(at) <= 1)
        n_groups = np.where(none, 0, total(self.n_groups))
        lengths = np.where(np.repeat(none, np.diff(bounds)), 0, self.n_groups.held[codes])
        links = self.links.held[ragged(lengths, self.first_link.held[codes])].astype(self.link_type)
        starts = np.concatenate([[0], np.cumsum(n_groups)]) * self.link_type.itemsize
        chunk_groups = list(map(self.groups.__getitem__, codes.tolist()))
        cuts = bounds.tolist()
        groups = ["" if no else ";".join(chunk_groups[s:t]) for s, t, no in zip(cuts, cuts[1:], none.tolist(), strict=False)]
        return {
            "n_a": pa.array(np.where(none, 0, total(self.tokens_a))), "n_b": pa.array(np.where(none, 0, total(self.tokens_b))),
            "n_groups": pa.array(n_groups), "n_links": pa.array(n_groups), "groups": pa.array(groups, pa.string()),
            "links": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(none), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(links)]).cast(pa.binary()),
        }


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker for two files; kept from task to task."""
    return held_by_worker(("align", a_path, b_path), lambda: Aligner(a_path, b_path))


def align_texts(docs: DataFrame, a_path: str, b_path: str, text: str = "text", folder: str | None = None) -> DataFrame:
    """A row per distinct text: ``blob`` (its SHA-256), ``copies``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of A and B of each group in order) and ``links`` (id pairs as a * B + b).

    A null text counts as empty.  Empty texts, and texts that the tokens of either file do not stand for byte by byte,
    have no tokens.  An empty table gives no rows.
    """
    texts = docs.select(F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for a, b in text_slices(batch.column(2)):
                found = own.align(batch.column(2).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *found.values()], names=["blob", "copies", *found])

    rows = texts.select(F.unhex(F.sha2("text", 256)).alias("blob"), "copies", F.concat(F.lit(" "), "text").alias("text"))
    return through_table(rows.mapInArrow(run, TEXTS), "aligned", folder)


def link_arrays(links: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of a column in one array, and where those of each row begin and end."""
    links = links.cast(pa.large_binary())
    _, offsets, data = links.buffers()
    at = np.frombuffer(offsets, np.int64)[links.offset : links.offset + len(links) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(held).view(np.dtype(f"<{'u4' if size == 4 else 'i8'}")).astype(np.int64), (at - at[0]) // size


def link_slices(links: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows that hold about ``SLICE_LINKS`` links each."""
    lengths = pc.binary_length(links).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(lengths) // size, 0
    while start < len(links):
        held = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, held + SLICE_LINKS, "right")))
        yield start, end
        start = end


def let_go() -> None:
    """Drops the aligner that this worker may still hold; looking at links needs none."""
    held_by_worker(("links",), lambda: None)


def link_bytes(a_path: str, b_path: str) -> tuple[int, int]:
    """Bytes of a stored link, and the size of B."""
    own = aligner(a_path, b_path)
    return own.link_type.itemsize, own.n_b


def pair_counts(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, count): in how many links of the corpus, copies counted, each pair of ids stands.

    Each task counts its own links first, so a pair moves once per task.
    """
    size, _ = link_bytes(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for a, b in link_slices(batch.column(0), size):
                links, at = link_arrays(batch.column(0).slice(a, b - a), size)
                copies = np.repeat(batch.column(1).slice(a, b - a).to_numpy(), np.diff(at))
                found, code = np.unique(links, return_inverse=True)
                sums = np.zeros(len(found), np.int64)
                np.add.at(sums, code, copies)
                both, code = np.unique(np.concatenate([pairs, found]), return_inverse=True)
                merged = np.zeros(len(both), np.int64)
                np.add.at(merged, code, np.concatenate([counts, sums]))
                pairs, counts = both, merged
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "count"])

    return texts.select("links", "copies").mapInArrow(run, "pair bigint, count bigint").groupBy("pair").agg(F.sum("count").alias("count"))


def measure(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``texts`` without ``links``, with ``n_best`` (links whose pair has its B id's highest count, ties too) and
    ``count_sum`` (counts of the pairs of all links)."""
    counted = pair_counts(texts, a_path, b_path).toArrow()  # bounded by the vocabularies, see above
    pair, count = counted["pair"].to_numpy(), counted["count"].to_numpy()
    size, n_b = link_bytes(a_path, b_path)
    order = np.argsort(pair)
    pair, count = pair[order], count[order]
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, pair % n_b, count)
    shared = texts.sparkSession.sparkContext.broadcast((pair, count, count == highest[pair % n_b]))
    kept = [c for c in texts.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        pairs, counts, best = shared.value
        for batch in batches:
            for a, b in link_slices(batch.column(len(kept)), size):
                part = batch.slice(a, b - a)
                links, at = link_arrays(part.column(len(kept)), size)
                where = np.searchsorted(pairs, links)
                sums = [np.concatenate([[0], np.cumsum(x[where], dtype=np.int64)]) for x in (best, counts)]
                added = [pa.array(s[at[1:]] - s[at[:-1]]) for s in sums]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *added], names=[*kept, "n_best", "count_sum"])

    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept), "n_best bigint, count_sum bigint"])
    return texts.select(*kept, "links").mapInArrow(run, schema)


def per_document(docs: DataFrame, measured: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The measures of its text for every row of ``docs``: the key beside all columns of ``measured`` but ``blob`` and ``copies``.

    Only keys and digests are moved.  Texts with very many copies, which are few by their number, are broadcast, so no
    task gets all copies of one.
    """
    blob = F.unhex(F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")), 256)).alias("blob")
    keys = through_table(docs.select(docs[key].alias("key_"), blob), "aligned-keys")
    measured = through_table(measured, "aligned-measures")
    columns = [c for c in measured.columns if c not in ("blob", "copies")]
    rows = keys.count()
    least = max(HOT_COPIES, -(-rows // HOT_TEXTS))
    hot, cold = measured.filter(F.col("copies") >= least), measured.filter(F.col("copies") < least)
    held = F.sum(F.length("groups")) if "groups" in columns else F.lit(0).cast("bigint")
    texts, size = hot.agg(F.count(F.lit(1)), F.coalesce(held, F.lit(0))).first() if rows else (0, 0)
    if not texts or size > HOT_BYTES:
        return keys.join(measured, "blob").select(F.col("key_").alias(key), *columns)
    few = F.broadcast(hot)
    found = keys.join(few, "blob").select(F.col("key_").alias(key), *columns)
    rest = keys.join(F.broadcast(hot.select("blob")), "blob", "left_anti").join(cold, "blob")
    return found.unionByName(rest.select(F.col("key_").alias(key), *columns))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """A row per document: the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``n_best``, ``count_sum``.

    ``a_path`` is a byte-level BPE file, ``b_path`` a sentencepiece model that sets a space before a text; A reads the
    text with that space.  A null, empty or not byte-true text has no tokens, zeros and empty groups; null keys and
    repeated rows stay, and every copy counts in the corpus-wide counts; an empty table gives no rows; other columns
    are left out.
    """
    return per_document(docs, measure(align_texts(docs, a_path, b_path, text, folder), a_path, b_path), text, key)
