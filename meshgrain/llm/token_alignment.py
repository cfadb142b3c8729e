"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same bytes, and which of them overlap.

Both tokenizers give every text as tokens with byte ends. Two pointers go along the end arrays. From a place where both have just
ended a token, exponential probing compares the arrays at the current index shift, twice as many ends each time, and jumps over
the whole one-to-one stretch; at the first difference the irregular group is walked through token by token until both end
together, which sets the new shift. Many stretches are worked on at once, as numpy lanes: a text is cut into lanes where both
tokenizers must end a token, before a space that follows a sign that is no white space.

The same cuts let a worker keep what tokenizers made of a stretch of text (mostly a word), so that frequent words are looked up.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshgrain.llm.common import Batches, stash

FOLDER = "/opt/tokenizers"
#: Characters of stretches that a worker remembers (about 100 MB with their tokens), characters worked on at once, and stretches in a lane.
KEPT, PIECE, LANE = 6_000_000, 1 << 20, 48
#: Id pairs whose corpus-wide counts are broadcast (about 200 MB in an executor); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
#: The pattern that splits text before the merges of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S) (?=.)", re.S)


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others by signs from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens, read from the vocabulary files in a folder that every machine has."""

    built: Tokenizers | None = None

    def __init__(self, folder: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> None:
        self.folder = folder
        with open(f"{folder}/{a}", encoding="utf-8") as f:
            vocabulary = json.load(f)
        signs, special = byte_signs(), {t["id"] for t in vocabulary["added_tokens"]}
        entries = {bytes(signs[c] for c in w): i for w, i in vocabulary["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=entries, special_tokens={})  # an entry's id is the rank of its merge
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b}")
        self.bytes_a = [b""] * (max(vocabulary["model"]["vocab"].values()) + 1)
        for w, i in entries.items():
            self.bytes_a[i] = w
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.sizes = tuple(np.array([len(x) for x in names], np.int64) for names in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids = (array("i"), array("i"))
        self.start = (array("q", [0]), array("q", [0]))
        self.good = bytearray()

    @classmethod
    def of(cls, folder: str) -> Tokenizers:
        """Built once in each worker process."""
        if cls.built is None or cls.built.folder != folder:
            cls.built = cls(folder)
        return cls.built

    def encoded(self, stretch: str) -> tuple[list[int], list[int]]:
        """Ids of a space and the stretch; b puts the space there itself."""
        return self.a.encode_ordinary(" " + stretch), self.b.encode(stretch)

    def numbers(self, stretches: list[str]) -> np.ndarray:
        """A number for each stretch, under which its tokens are kept. What was kept before may go; these numbers hold until the next call."""
        if self.chars > KEPT:
            self.clear()
        get, out = self.number.get, np.empty(len(stretches), np.int64)
        for i, s in enumerate(stretches):
            n = get(s, -1)
            if n < 0:
                n = self.number[s] = len(self.good)
                whole = (" " + s).encode("utf-8", "replace")
                same = True
                for ids, kept, start, names in zip(self.encoded(s), self.ids, self.start, (self.bytes_a, self.bytes_b), strict=True):
                    kept.extend(ids)
                    start.append(len(kept))
                    same = same and b"".join([names[x] for x in ids]) == whole
                self.good.append(same)
                self.chars += len(s) + 8
            out[i] = n
        return out

    def tokens(self, numbers: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the stretches one after another, how many each has)."""
        if not len(numbers):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        start = np.frombuffer(self.start[side], np.int64)
        many = start[numbers + 1] - start[numbers]
        first = np.repeat(start[numbers] - (np.cumsum(many) - many), many)
        return np.frombuffer(self.ids[side], np.int32)[first + np.arange(len(first))], many


@dataclass
class Links:
    """Which tokens end a group, on either side, and all pairs of places of tokens whose bytes overlap."""

    ends_a: np.ndarray
    ends_b: np.ndarray
    a: np.ndarray
    b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray, lanes_a: np.ndarray, lanes_b: np.ndarray) -> Links:
    """Groups and links of two rising arrays of byte ends that reach the same last end.

    lanes_a and lanes_b: places of the first tokens of each lane, where both sides start at the same byte; the first lane starts at 0.
    """
    i, j = lanes_a.astype(np.int64), lanes_b.astype(np.int64)
    stop = np.r_[i[1:], len(ends_a)]
    out = Links(np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stop_b = np.r_[j[1:], len(ends_b)]
    live = i < stop
    i, j, stop, stop_b = i[live], j[live], stop[live], stop_b[live]
    width = np.ones(len(i), np.int64)
    while len(i):
        # probe: the next `width` ends of every lane at its index shift
        w = np.minimum(width, np.minimum(stop - i, stop_b - j))
        begin = np.cumsum(w) - w
        step = np.arange(int(w.sum())) - np.repeat(begin, w)
        at_a, at_b = np.repeat(i, w) + step, np.repeat(j, w) + step
        differ = ends_a[at_a] != ends_b[at_b]
        run = np.minimum.reduceat(np.where(differ, step, len(step)), begin)
        run = np.minimum(run, w)
        same = step < np.repeat(run, w)
        found.append((at_a[same], at_b[same]))
        out.ends_a[at_a[same]] = out.ends_b[at_b[same]] = True
        i, j = i + run, j + run
        width = np.where(run == w, 2 * width, 1)
        # irregular groups, token by token until both sides end together
        odd = np.flatnonzero(run < w)
        p, q = i[odd], j[odd]
        while len(odd):
            found.append((p.copy(), q.copy()))
            x, y = ends_a[p], ends_b[q]
            met = x == y
            out.ends_a[p[met]] = out.ends_b[q[met]] = True
            i[odd[met]], j[odd[met]] = p[met] + 1, q[met] + 1
            p, q, odd = (p + (x < y))[~met], (q + (x > y))[~met], odd[~met]
        more = i < stop
        i, j, stop, stop_b, width = i[more], j[more], stop[more], stop_b[more], width[more]
    if found:
        out.a, out.b = (np.concatenate(x) for x in zip(*found, strict=True))
    return out


@dataclass
class Piece:
    """Texts, or stretches of long ones, aligned together. owner: the row of each token; rows that are not `good` have none."""

    owner_a: np.ndarray
    owner_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    links: Links


def pieces(texts: Sequence[str | None], tools: Tokenizers) -> Iterator[tuple[list[int], Piece, np.ndarray]]:
    """(rows, piece, bad rows) of about PIECE characters each; a long text is spread over several, one after another."""
    rows: list[int] = []
    stretches: list[list[str]] = []
    size = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        parts, at = _CUT.split(text), 0
        while at < len(parts):
            took, end = 0, at
            while end < len(parts) and (end == at or size + took < PIECE):
                took += len(parts[end]) + 1
                end += 1
            rows.append(row)
            stretches.append(parts[at:end])
            size, at = size + took, end
            if size >= PIECE:
                yield _piece(rows, stretches, tools)
                rows, stretches, size = [], [], 0
    if rows:
        yield _piece(rows, stretches, tools)


def _piece(rows: list[int], stretches: list[list[str]], tools: Tokenizers) -> tuple[list[int], Piece, np.ndarray]:
    numbers = tools.numbers([s for part in stretches for s in part])
    many = np.array([len(s) for s in stretches])
    owner = np.repeat(np.array(rows, np.int64), many)
    bad = np.unique(owner[~np.frombuffer(tools.good, bool)[numbers]])
    keep = ~np.isin(owner, bad)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))[keep]  # of the stretch in its text
    numbers, owner = numbers[keep], owner[keep]
    sides = [tools.tokens(numbers, side) for side in (0, 1)]
    ends = [np.cumsum(sizes[ids]) for (ids, _), sizes in zip(sides, tools.sizes, strict=True)]
    lane = place % LANE == 0
    starts = [(np.cumsum(n) - n)[lane] for _, n in sides]
    return rows, Piece(np.repeat(owner, sides[0][1]), np.repeat(owner, sides[1][1]), sides[0][0], sides[1][0], align(*ends, *starts)), bad


def alignment(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, a and b (token ids), group_a and group_b (how many tokens each group has), link_a and link_b
    (places of overlapping tokens, in order).

    a is of byte_bpe_50k.json over a space and the text, b of piece_bpe_32k.model over the text, to which it adds the space. Groups lie
    between byte places where both end a token. Texts that are null or empty, and those that a tokenizer does not give back byte by byte, have empty
    arrays. Repeated rows and doc_ids are aligned each for itself, an empty table gives an empty one, other columns are ignored. Very long
    texts are aligned whole, in stretches of about a million characters; their tokens have to fit in a worker, as one row.
    """
    names = ("a", "b", "group_a", "group_b", "link_a", "link_b")

    def aligned(batches: Batches) -> Batches:
        tools = Tokenizers.of(folder)
        for batch in batches:
            rows: list[dict[str, list]] = [{c: [] for c in names} for _ in range(len(batch))]
            bad: set[int] = set()
            for own, piece, wrong in pieces(batch["text"].to_pylist(), tools):
                bad.update(wrong.tolist())
                for row in dict.fromkeys(own):
                    la, lb = piece.links.a, piece.links.b
                    sa, sb = (np.searchsorted(x, [row, row + 1]) for x in (piece.owner_a, piece.owner_b))
                    if sa[0] == sa[1]:
                        continue
                    mine = (la >= sa[0]) & (la < sa[1])
                    order = np.argsort(la[mine] + lb[mine])
                    before_a, before_b = (sum(map(len, rows[row][c])) for c in ("a", "b"))
                    sized = [np.diff(np.r_[-1, np.flatnonzero(e[s[0] : s[1]])]) for e, s in ((piece.links.ends_a, sa), (piece.links.ends_b, sb))]
                    for c, x in zip(names, (piece.a[sa[0] : sa[1]], piece.b[sb[0] : sb[1]], *sized, la[mine][order] - sa[0] + before_a, lb[mine][order] - sb[0] + before_b), strict=True):
                        rows[row][c].append(x.astype(np.int32))
            made = [pa.array([np.concatenate(r[c]) if r[c] and i not in bad else [] for i, r in enumerate(rows)], pa.list_(pa.int32())) for c in names]
            yield pa.record_batch([batch["doc_id"], *made], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(aligned, f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in names))


def _names(size: int, end: str) -> np.ndarray:
    """Each id in decimal and a sign after it, as rows of 8 bytes filled up with zeros."""
    return np.array([f"{i}{end}".encode() for i in range(size)], "S8").view(np.uint8).reshape(size, 8)


class Texts:
    """Groups as text: ids of each group joined by commas, the two sides by a bar, groups by semicolons."""

    def __init__(self, most_a: int, most_b: int) -> None:
        self.comma, self.bar, self.semicolon = _names(max(most_a, most_b), ","), _names(most_a, "|"), _names(most_b, ";")

    def of(self, piece: Piece) -> tuple[bytes, np.ndarray]:
        """All groups of a piece, every group with its semicolon, and how many bytes each B token's row has up to each group's end."""
        ends_a, ends_b = np.flatnonzero(piece.links.ends_a), np.flatnonzero(piece.links.ends_b)
        # a token's place among all: those of its own side before it, and those of the other side's groups before it
        group_a, group_b = (np.cumsum(e) - e for e in (piece.links.ends_a.astype(np.int64), piece.links.ends_b.astype(np.int64)))
        at_a = np.arange(len(piece.a)) + np.r_[0, ends_b + 1][group_a]
        at_b = np.arange(len(piece.b)) + (ends_a + 1)[group_b]
        cells = np.empty((len(piece.a) + len(piece.b), 8), np.uint8)
        cells[at_a] = np.where(piece.links.ends_a[:, None], self.bar[piece.a], self.comma[piece.a])
        cells[at_b] = np.where(piece.links.ends_b[:, None], self.semicolon[piece.b], self.comma[piece.b])
        full = cells != 0
        return cells[full].tobytes(), np.cumsum(full.sum(axis=1))[at_b[ends_b]]


def alignment_counts(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Every row of docs (doc_id, text) as alignment() has it, in figures: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    An id pair counts each row of docs that holds it linked, over all rows. n_best: links whose pair has the highest count of all pairs of
    its A id, ties included; count_sum: the sum of the counts over all links. groups_sha256: of the groups as text (`a1,a2|b1;a3|b2`), empty
    without tokens. The tokens themselves are not written anywhere: a row keeps its distinct pairs and how often it has each. Null, empty, repeated
    and very long texts as in alignment().
    """

    def figures(batches: Batches) -> Batches:
        tools = Tokenizers.of(folder)
        most_a, most_b = len(tools.bytes_a), len(tools.bytes_b)
        texts = Texts(most_a, most_b)
        for batch in batches:
            n = len(batch)
            counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
            bad: set[int] = set()
            hashes: dict[int, object] = {}
            held: list[np.ndarray] = []
            left: dict[int, bytes] = {}
            for own, piece, wrong in pieces(batch["text"].to_pylist(), tools):
                bad.update(wrong.tolist())
                owner = piece.owner_a[piece.links.a]
                for c, rows in (("n_a", piece.owner_a), ("n_b", piece.owner_b), ("n_groups", piece.owner_b[piece.links.ends_b]), ("n_links", owner)):
                    counts[c] += np.bincount(rows, minlength=n)
                held.append(np.stack(np.unique((owner * most_a + piece.a[piece.links.a]) * most_b + piece.b[piece.links.b], return_counts=True)))
                text, upto = texts.of(piece)
                last = piece.owner_b[piece.links.ends_b]
                begin = 0
                for row in dict.fromkeys(own):
                    k = int(np.searchsorted(last, row, "right"))
                    end = int(upto[k - 1]) if k else 0
                    if end > begin:
                        h = hashes.setdefault(row, sha256())
                        h.update(left.pop(row, b"") + text[begin : end - 1])
                        left[row] = b";"  # the next group's, if there is one
                    begin = max(begin, end)
            pairs = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            if (np.diff(pairs[0]) <= 0).any():  # a text of several pieces
                keys, where = np.unique(pairs[0], return_inverse=True)
                times = np.zeros(len(keys), np.int64)
                np.add.at(times, where, pairs[1])
                pairs = np.stack([keys, times])
            row = pairs[0] // (most_a * most_b)
            good = ~np.isin(row, list(bad))
            row, key, times = row[good], (pairs[0] % (most_a * most_b))[good], pairs[1][good]
            for c in counts.values():
                c[list(bad)] = 0
            bound = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            digests = [hashes[i].hexdigest() if i in hashes and i not in bad else "" for i in range(n)]
            yield pa.record_batch(
                [batch["doc_id"], *map(pa.array, counts.values()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(bound, pa.array(key)), pa.ListArray.from_arrays(bound, pa.array(times.astype(np.int32)))],
                names=["doc_id", *counts, "groups_sha256", "keys", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(figures, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<int>")
    rows = stash(made.withColumn("row", F.monotonically_increasing_id()))
    count = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("count"))
    count = stash(count.withColumn("a", F.expr(f"key div {_pieces_b(folder)}")))
    best = count.groupBy("a").agg(F.max("count").alias("most"))  # a row for each A id
    count = count.join(F.broadcast(best), "a").select("key", "count", (F.col("count") == F.col("most")).alias("best"))
    if count.count() <= BROADCAST_PAIRS:
        count = F.broadcast(count)
    held = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))
    sums = held.join(count, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = rows.drop("keys", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def _pieces_b(folder: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model").get_piece_size()
