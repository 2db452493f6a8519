"""Byte-level BPE in DuckDB, inside Spark tasks.

Each task holds one in-memory DuckDB (one thread, bounded memory, no spill folder). Words become rows of token
positions; a recursive query joins neighbouring positions with the merge table and contracts the leftmost pair of
minimum rank of every word until no pair of it is in the table. Decoding joins ids with the vocabulary and aggregates
their bytes in order. Equal words are encoded once per worker (see :mod:`scorelake.llm.chunks`).

A word that is an entry of the vocabulary is that entry. A word of more than ``LONG`` bytes joins its positions with the merge
table once per step and contracts in one step every pair that must be contracted anyway, so that steps are few and only
the newest state is held, whatever the word's length. Such pairs are (see :func:`certain`) those no merge of smaller rank
can take a token from: neighbours can only grow, so the tables ``lefts`` and ``rights`` hold the smallest rank that a grown
neighbour could merge at; and those that come first among all pairs within the length of the longest token, beyond
which no chain of merges reaches.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows each get their row; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.chunks import Pieces
from scorelake.llm.common import map_batches, text_of

LONG = 256                       # bytes; longer words take the step-by-step form
STATE_ROWS = 1_500_000             # rows of all steps of one recursive query, but for a single word
BLOCK = 32_768                   # new pieces that are encoded and decoded together
MEMORY = "250MB"
NEVER = 1 << 40                  # above all ranks

# A row's key holds the number of its word (high bits) and its position there.
ENCODE = """
with recursive state(step, key, id) as (
    select 0, word::bigint << 32 | pos, id from symbols
    union all
    (with neighbours as materialized (
        select step, key, id, lead(id) over seq next_id, lead(key) over seq next_key
        from state window seq as (order by key)),
    chosen as materialized (
        select key >> 32 word, min(merged::bigint << 32 | (key & 4294967295)) best,
               arg_min(next_key, merged::bigint << 32 | (key & 4294967295)) gone
        from neighbours join merges on id = first_id and next_id = second_id
        where next_key >> 32 = key >> 32 group by key >> 32)
    select step + 1, key, case when key & 4294967295 = best & 4294967295 then (best >> 32)::int else id end
    from neighbours join chosen on word = key >> 32 where key <> gone)
)
select key >> 32 word, id
from state join (select key >> 32 word, max(step) last_step from state group by key >> 32) on word = key >> 32 and step = last_step
order by key
"""

PAIRS = """
select place, merged, alone, l.least left_least, r.least right_least
from places join merges on id = first_id and next_id = second_id
left join lefts l on l.before = previous_id and l.token = id
left join rights r on r.token = next_id and r.behind = after_id
"""

DECODE = """
select doc, list(bytes order by pos) parts from tokens join vocabulary using (id) group by doc order by doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class DuckCodec(Pieces):
    """Encoder and decoder of one worker, with the ids, their decimal text and the decoded bytes of known pieces and words.

    ``limit`` pieces and ``word_limit`` words bound its memory, not the work: a word table beyond its limit starts anew."""

    def __init__(self, path: str, pattern: str, limit: int = 200_000, word_limit: int = 400_000):
        import duckdb
        import regex

        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[token[:k]], self.ranks[token[k:]], rank) for token, rank in self.ranks.items()
                 for k in range(1, len(token)) if token[:k] in self.ranks and token[k:] in self.ranks]
        first, second, merged = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
        bold = np.concatenate([first[merged < first], second[merged < second]])   # a pair with it ranks below it
        self.longest = max(map(len, self.ranks))
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = [len(token) for token in self.ranks]
        self.db = duckdb.connect(":memory:", config={
            "threads": 1, "memory_limit": MEMORY, "temp_directory": "", "allocator_flush_threshold": "8MB"})
        self._load("merges", first_id=first, second_id=second, merged=merged, alone=~np.isin(merged, bold))
        self._load_growth(pairs)
        self._load("vocabulary", id=np.array(list(self.ranks.values()), np.int32),
                   bytes=pa.array(list(self.ranks), pa.binary()))
        self.decimal, self.raw, self.word_limit = [b""], [b""], word_limit
        self._forget_words()
        super().__init__(self._encode, limit)

    def _load(self, name: str, **columns) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"create or replace temp table {name} as select * from given").fetchall()
        self.db.unregister("given")

    def _keep(self, kept: np.ndarray) -> None:
        self.decimal, self.raw = ([held[k] for k in kept.tolist()] for held in (self.decimal, self.raw))

    def _symbols(self, words: list[bytes]) -> dict[str, np.ndarray]:
        sizes = np.array([len(w) for w in words])
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        return {"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
                "pos": (np.arange(len(starts)) - starts).astype(np.int64),
                "id": self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]}

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        self._load("symbols", **self._symbols(words))
        found = self.db.sql(ENCODE).to_arrow_table()
        counts = np.bincount(found["word"].to_numpy(), minlength=len(words))
        return np.split(found["id"].to_numpy(), np.cumsum(counts)[:-1])

    def _load_growth(self, pairs: list[tuple[int, int, int]]) -> None:
        """Smallest rank at which a token merges with a neighbour that has grown: keys are the neighbour as it is now."""
        names = {rank: token for token, rank in self.ranks.items()}
        lefts: dict[tuple[int, int], int] = {}
        rights: dict[tuple[int, int], int] = {}
        for first, second, rank in pairs:
            left, right = names[first], names[second]
            for found, keys in ((lefts, ((self.ranks.get(left[k:]), second) for k in range(1, len(left)))),
                                (rights, ((first, self.ranks.get(right[:k])) for k in range(1, len(right))))):
                for key in keys:
                    if None not in key:
                        found[key] = min(rank, found.get(key, rank))
        for name, found, columns in (("lefts", lefts, ("before", "token")), ("rights", rights, ("token", "behind"))):
            table = np.array([(*key, rank) for key, rank in found.items()], np.int32).reshape(-1, 3).T
            self._load(name, **dict(zip((*columns, "least"), table, strict=True)))

    def _contract_long(self, word: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        born = np.zeros(len(ids), np.int64)             # rank up to which all merges are done when the token comes up
        while len(ids) > 1:
            beyond = np.concatenate([[-1], ids, [-1, -1]]).astype(np.int32)
            self._load("places", place=np.arange(len(ids) - 1), previous_id=beyond[:-4], id=ids[:-1], next_id=ids[1:],
                       after_id=beyond[3:-1])
            found = {k: v.to_numpy() for k, v in zip(
                ("place", "merged", "alone", "left_least", "right_least"), self.db.sql(PAIRS).to_arrow_table().columns)}
            if not len(found["place"]):
                break
            rank = np.full(len(ids) - 1, NEVER, np.int64)
            alone = np.zeros(len(rank), bool)
            least = np.full((2, len(rank)), NEVER, np.int64)
            rank[found["place"]], alone[found["place"]] = found["merged"], found["alone"]
            for side, name in enumerate(("left_least", "right_least")):
                known = ~np.isnan(found[name].astype(float))
                least[side, found["place"][known]] = found[name][known]
            time = np.where(rank < NEVER, np.maximum(rank, np.maximum(born[:-1], born[1:])), NEVER)
            hits = np.flatnonzero(certain(rank, time, alone, *least, self.sizes[ids], self.longest))
            ids, born = ids.copy(), born.copy()
            ids[hits], born[hits] = rank[hits], time[hits]
            ids, born = np.delete(ids, hits + 1), np.delete(born, hits + 1)
        return ids

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct words, each encoded on its own."""
        out: list = [None] * len(words)
        held, rows = [], 0
        for k, word in enumerate(words):
            if word in self.ranks:
                out[k] = np.array([self.ranks[word]], np.int32)
            elif len(word) > LONG:
                out[k] = self._contract_long(word)
            else:
                held.append(k)
                rows += len(word) * (len(word) + 1) // 2
                if rows > STATE_ROWS:
                    for j, ids in zip(held, self._contract([words[j] for j in held]), strict=True):
                        out[j] = ids
                    held, rows = [], 0
        if held:
            for j, ids in zip(held, self._contract([words[j] for j in held]), strict=True):
                out[j] = ids
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of consecutive runs of ids: run k has ``counts[k]`` of them."""
        out = [b""] * len(counts)
        for start, stop in _slices(counts, 100_000):
            size = counts[start:stop]
            begins = np.cumsum(size) - size
            first = int(counts[:start].sum())
            part = ids[first:first + int(size.sum())]
            self._load("tokens", doc=np.repeat(np.arange(start, stop), size), id=part.astype(np.int32),
                       pos=np.arange(len(part)) - np.repeat(begins, size))
            found = self.db.sql(DECODE).to_arrow_table()
            parts = found["parts"].combine_chunks()
            # Parts lie in order in one buffer: a run's bytes are a slice of it.
            values = parts.flatten().cast(pa.large_binary())
            begin, raw = values.offset, values.buffers()[2]
            edges = np.frombuffer(values.buffers()[1], np.int64)[begin:begin + len(values) + 1]
            places = edges[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])].tolist()
            data = raw.to_pybytes() if raw else b""
            for doc, a, b in zip(found["doc"].to_pylist(), places[:-1], places[1:], strict=True):
                out[doc] = data[a:b]
        return out

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        blocks = [self._block(pieces[k:k + BLOCK]) for k in range(0, len(pieces), BLOCK)]
        return tuple(map(np.concatenate, zip(*blocks, strict=True)))

    def _learn(self, words: list[str]) -> None:
        """Encode and decode new words, numbered in their order."""
        found = self.words([word.encode() for word in words])
        lengths = np.array([len(x) for x in found], np.int64)
        ids = np.concatenate(found)
        self.word_decimal += [",".join(map(str, x.tolist())).encode() for x in found]
        self.word_raw += self.decode(ids, lengths)
        self.word_ids, self.word_lengths = np.concatenate([self.word_ids, ids]), np.concatenate([self.word_lengths, lengths])

    def _block(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.word_numbers) > self.word_limit or self.word_held > self.characters:
            self._forget_words()
        numbers, findall = self.word_numbers, self.pattern.findall
        known = len(numbers)
        made = [[numbers.setdefault(word, len(numbers)) for word in findall(piece)] for piece in pieces]
        if len(numbers) > known:
            new = list(islice(numbers, known, None))
            self.word_held += sum(map(len, new))
            self._learn(new)
        sizes = np.array([len(x) for x in made], np.int64)
        flat = np.array(list(chain.from_iterable(made)), np.int64)
        lengths = self.word_lengths[flat]
        starts = (np.cumsum(self.word_lengths) - self.word_lengths)[flat]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.word_ids[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)]
        decimal, raw = self.word_decimal, self.word_raw
        self.decimal += [decimal[x[0]] if len(x) == 1 else b",".join([decimal[k] for k in x]) for x in made]
        self.raw += [raw[x[0]] if len(x) == 1 else b"".join([raw[k] for k in x]) for x in made]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])

    def _forget_words(self) -> None:
        self.word_numbers, self.word_held = {}, 0
        self.word_ids, self.word_lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.word_decimal, self.word_raw = [], []


def _every_second(sure: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Neighbouring sure pairs come at the same place in the order: of such a run every second one is contracted, from its
    left end, unless a pair before the run comes at that place too but isn't sure."""
    before = np.concatenate([[NEVER << 22], order[:-1]])
    places = np.arange(len(sure))
    starts = sure & ~np.concatenate([[False], sure[:-1]])
    opened = np.maximum.accumulate(np.where(starts, places, -1))
    return sure & (before[opened] != order[opened]) & ((places - opened) % 2 == 0)


def _least_within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of ``values[lo:hi]`` for every pair of bounds; empty ranges have none."""
    out = np.full(len(lo), NEVER << 22)
    sizes = hi - lo
    table, width = values, 1
    while width <= sizes.max(initial=0):
        here = np.flatnonzero((sizes >= width) & (sizes < 2 * width))
        out[here] = np.minimum(table[lo[here]], table[hi[here] - width])
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def certain(rank: np.ndarray, time: np.ndarray, alone: np.ndarray, left_least: np.ndarray, right_least: np.ndarray,
            sizes: np.ndarray, reach: int) -> np.ndarray:
    """Which pairs (k, k + 1) the contraction by leftmost minimum rank will contract, whatever happens elsewhere.

    ``rank`` is ``NEVER`` for pairs that don't merge, ``time`` the rank that the contraction has come to when both tokens of
    the pair are there, ``alone`` says that no pair with the new token ranks below it, ``sizes`` are the tokens' bytes and
    ``reach`` those of the longest token. The first pair in order always is among them."""
    none = np.array([NEVER])
    left, right = np.concatenate([none, rank[:-1]]), np.concatenate([rank[1:], none])
    grown = (time == rank) & (rank < NEVER) & alone & (left >= rank) & (right >= rank) & (left_least > rank) & (right_least >= rank)
    hits = _every_second(grown, rank)
    if hits.sum() * 16 >= (rank < NEVER).sum():
        return hits
    # A merge farther away would have to grow into a token longer than any.
    order = np.where(rank < NEVER, time << 22 | rank, NEVER << 22)
    places, ends = np.arange(len(rank)), np.cumsum(sizes)
    starts = ends - sizes
    lo = np.minimum(np.maximum(np.searchsorted(starts, ends[:-1] - reach, side="right") - 1, 0), places)
    hi = np.maximum(np.minimum(np.searchsorted(ends, starts[1:] + reach), len(rank)), places + 1)
    first = (rank < NEVER) & (_least_within(order, places + 1, hi) >= order)
    earlier = _least_within(order, lo, places)
    near = _every_second(first & alone & (earlier >= order), order) | (first & ~alone & (earlier > order))
    # A pair that shares a token with one chosen above waits.
    touched = hits | np.concatenate([[False], hits[:-1]]) | np.concatenate([hits[1:], [False]])
    return hits | (near & ~touched)


def _slices(counts: np.ndarray, most: int):
    """Consecutive slices with about ``most`` ids; one run is never cut."""
    block = (np.cumsum(counts) - counts) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(counts)]])
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


_workers: dict[tuple[str, str], DuckCodec] = {}


def codec(path: str, pattern: str) -> DuckCodec:
    if (path, pattern) not in _workers:
        _workers[path, pattern] = DuckCodec(path, pattern)
    return _workers[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids`` of every whole text."""
    chosen = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = codec(path, pattern).tokens(batch.column(1))
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.ListArray.from_arrays(edges, ids)],
                                          ["id", "n_tokens", "ids"])

    id_type = chosen.schema["id"].dataType.simpleString()
    return map_batches(chosen, f"id {id_type}, n_tokens long, ids array<int>", work).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, decoded`` (bytes) of lists of ids; a null list decodes to no bytes."""
    chosen = tokens.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        raw = codec(path, pattern).decode(ids, np.diff(lists.offsets.to_numpy()).astype(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "decoded"])

    id_type = chosen.schema["id"].dataType.simpleString()
    return map_batches(chosen, f"id {id_type}, decoded binary", work).withColumnRenamed("id", id_col)


def roundtrip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``id, n_tokens`` and the SHA-256 of the decimal ids and of the decoded bytes."""
    chosen = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = codec(path, pattern)
        pieces, sizes = known.numbers(batch.column(1))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(np.concatenate([[0], np.cumsum(known.lengths[pieces])])[edges])
        ids_sha, raw_sha = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = pieces[a:b].tolist()
            ids_sha.append(sha256(b",".join([known.decimal[k] for k in own if k])).hexdigest())
            raw_sha.append(sha256(b"".join([known.raw[k] for k in own])).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(ids_sha), pa.array(raw_sha)],
                                          ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = chosen.schema["id"].dataType.simpleString()
    return map_batches(chosen, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string", work,
                       rows=1024).withColumnRenamed("id", id_col)
