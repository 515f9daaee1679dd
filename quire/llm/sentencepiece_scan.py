"""SentencePiece encoding and decoding of documents of any length by a max-plus scan.

The public vocabulary is of the BPE kind.  A segmentation is the one BPE gives exactly if
every neighbouring pair of pieces is compatible, that is if BPE leaves their concatenation
as that pair.  So encoding is a best path in a lattice whose nodes are pieces and whose
edges weigh 0 where compatible and minus infinity elsewhere: max-plus algebra with exact
weights.

A document is split into chunks of characters.  The states at a boundary are the pieces
that cover the character before it.  A chunk yields the matrix of best weights from its
entry states to its exit states; matrices combine associatively, forward and backward, and
the state on the best path at every boundary follows.  Then each chunk backtraces alone.
Where a white-space mark begins a new word every path passes, so inside a chunk only the
fragments at its two ends need the lattice; whole words go to the library, each distinct
one once per worker.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import documents, stash

DEFAULT_MODEL = "piece_bpe_32k.model"
MARK = "▁"
CHUNK = 1 << 15
#: Chunks whose matrices are multiplied in one task.
RUN = 256
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = -np.inf


class Pieces:
    """The vocabulary: BPE of words through the library, and the lattice of compatible pieces."""

    def __init__(self, path: str, most_cached: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError(f"{path} is no model of the BPE kind")
        model.normalizer_spec.add_dummy_prefix = False  # marks are put in here, once per document
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.text = {i: p.piece for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.longest = max(map(len, self.id))
        bytes_of = {i: bytes([b]) for b, i in self.byte.items()} | {i: t.replace(MARK, " ").encode() for i, t in self.text.items()}
        #: What each id adds to a text; None where an id stands for no text.
        self.raw = [bytes_of.get(i) for i in range(len(model.pieces))]
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece goes on past the start of a word")
        self._fits: dict[tuple[str, str], bool] = {}
        self._stands: dict[str, bool] = {}
        library = self.library

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= most_cached:
                    self.clear()
                self[word] = out = np.array(library.encode(word), "<u4").tobytes()
                return out

        self.word = Words().__getitem__

    def spelled(self, piece: str) -> bytes:
        """Ids of one lattice piece: its own, or those of the bytes of an unknown character."""
        known = self.id.get(piece)
        return np.array([known] if known is not None else [self.byte[b] for b in piece.encode()], "<u4").tobytes()

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            if right.startswith(MARK) and not left.endswith(MARK):
                found = True
            else:
                found = np.array(self.library.encode(left + right), "<u4").tobytes() == self.spelled(left) + self.spelled(right)
            self._fits[key] = found
        return found

    def stands(self, piece: str) -> bool:
        """Is it a piece that BPE leaves whole?"""
        known = self.id.get(piece)
        if known is None:
            return False
        if piece not in self._stands:
            self._stands[piece] = self.library.encode(piece) == [known]
        return self._stands[piece]

    def at(self, text: str, start: int, stop: int) -> list[int]:
        """Ends of the pieces that begin at `start`, up to `stop`."""
        longer = range(start + 2, min(stop, start + self.longest) + 1)
        return [start + 1, *(e for e in longer if self.stands(text[start:e]))] if start < stop else []

    def covering(self, text: str, boundary: int) -> list[tuple[int, int]]:
        """Pieces (start, end) that cover the character before the boundary."""
        return [(s, e) for s in range(max(0, boundary - self.longest), boundary) for e in self.at(text, s, len(text)) if e >= boundary]


class Chunk:
    """A stretch [begin, end) of a marked text of which `longest` characters on either side are known."""

    def __init__(self, pieces: Pieces, text: str, begin: int, end: int):
        self.p, self.text, self.begin, self.end = pieces, text, begin, end
        self.entries = pieces.covering(text, begin) if begin else [(0, 0)]
        self.exits = pieces.covering(text, end) if end > begin else self.entries
        cuts = [m.start() for m in re.finditer(f"(?<!{MARK}){MARK}", text[begin - 1 if begin else 0 : end])]
        cuts = [c + (begin - 1 if begin else 0) for c in cuts]
        cuts = [c for c in cuts if c >= begin and (c or not begin)]
        self.first, self.last = (cuts[0], cuts[-1]) if cuts else (None, None)

    def _sweep(self, sources: list[tuple[int, int]], stop: int, goals: list[tuple[int, int]] | None):
        """Best predecessor sets: for every node, a bit mask of the sources that reach it."""
        text, p = self.text, self.p
        reach: dict[tuple[int, int], int] = {}
        ending: dict[int, list[tuple[int, int]]] = {}
        for k, node in enumerate(sources):
            reach[node] = reach.get(node, 0) | 1 << k
            ending.setdefault(node[1], [])
            if node not in ending[node[1]]:
                ending[node[1]].append(node)
        limit = len(text) if goals is not None else stop
        for s in range(min(e for _, e in sources), stop):
            before = ending.get(s)
            if not before:
                continue
            for e in p.at(text, s, limit):
                mask, piece = 0, text[s:e]
                for node in before:
                    if node[0] == node[1] or p.fits(text[node[0] : node[1]], piece):
                        mask |= reach[node]
                if mask:
                    reach[(s, e)] = reach.get((s, e), 0) | mask
                    if (s, e) not in ending.setdefault(e, []):
                        ending[e].append((s, e))
        return reach, ending

    def _weights(self, sources, reach, goals) -> np.ndarray:
        return np.array([[0.0 if reach.get(g, 0) >> k & 1 else _NONE for g in goals] for k in range(len(sources))])

    def transfer(self) -> np.ndarray:
        """Best weight from each entry state to each exit state."""
        if self.end == self.begin:
            return np.where(np.eye(len(self.entries), dtype=bool), 0.0, _NONE)
        if self.first is None:
            reach, _ = self._sweep(self.entries, self.end, self.exits)
            return self._weights(self.entries, reach, self.exits)
        # every path passes the cuts: the matrix is an outer sum of two vectors
        reach, ending = self._sweep(self.entries, self.first, None)
        head = np.array([
            0.0 if any(reach[n] >> k & 1 for n in ending.get(self.first, [])) else _NONE for k in range(len(self.entries))
        ])
        gate = [(self.last, self.last)]
        reach, _ = self._sweep(gate, self.end, self.exits)
        return head[:, None] + self._weights(gate, reach, self.exits)[0][None, :]

    def _path(self, source, goals, stop: int, open_end: bool) -> list[str]:
        """Pieces after `source` up to the goal it reaches; the path is the only one of weight 0."""
        reach, ending = self._sweep([source], stop, goals if open_end else None)
        node = next(g for g in goals if reach.get(g))
        out = []
        while node != source:
            out.append(self.text[node[0] : node[1]])
            node = next(
                b for b in ending[node[0]]
                if reach.get(b) and (b[0] == b[1] or self.p.fits(self.text[b[0] : b[1]], self.text[node[0] : node[1]]))
            )
        return out[::-1]

    def backtrace(self, entry: int, exit_: int) -> bytes:
        """Ids after the entry state up to and with the exit state."""
        source, goal = self.entries[entry], self.exits[exit_]
        if self.end == self.begin:
            return b""
        spell = self.p.spelled
        if self.first is None:
            return b"".join(map(spell, self._path(source, [goal], self.end, True))) if goal != source else b""
        out = []
        if source[1] < self.first:
            reach, ending = self._sweep([source], self.first, None)
            goals = [n for n in ending.get(self.first, []) if reach.get(n)]
            out += map(spell, self._path(source, goals, self.first, False))
        out += map(self.p.word, _WORD.findall(self.text[self.first : self.last]))
        out += map(spell, self._path((self.last, self.last), [goal], self.end, True))
        return b"".join(out)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: best weight over every state between."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of neighbouring matrices, combined pairwise."""
    while len(matrices) > 1:
        pairs = [times(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def scan(matrices: list[np.ndarray], entry: int | None = None, exit_: int | None = None) -> list[int]:
    """The state at every boundary (one more than matrices) on the best path, between the given
    states at both ends where they are known.

    Prefixes and suffixes of the max-plus product are combined by doubling.
    """

    def prefixes(ms: list[np.ndarray], flip: bool) -> list[np.ndarray]:
        done, step = list(ms), 1
        while step < len(done):
            done = [
                m if i < step else (times(m, done[i - step]) if flip else times(done[i - step], m)) for i, m in enumerate(done)
            ]
            step *= 2
        return done

    def only(size: int, state: int | None) -> np.ndarray:
        return np.zeros(size) if state is None else np.where(np.arange(size) == state, 0.0, _NONE)

    start, end = only(matrices[0].shape[0], entry), only(matrices[-1].shape[1], exit_)
    forward = [start, *((start[:, None] + m).max(0) for m in prefixes(matrices, False))]
    backward = [*((m + end[None, :]).max(1) for m in prefixes(matrices[::-1], True))][::-1] + [end]
    return [int(np.argmax(f + b)) for f, b in zip(forward, backward, strict=True)]


_loaded: dict[str, Pieces] = {}


def pieces(path: str | None = None) -> Pieces:
    path = path or public_tokenizers.path(DEFAULT_MODEL)
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def marked(text: str) -> str:
    """The text as the vocabulary spells it: a mark before it and in place of each space."""
    return MARK + text.replace(" ", MARK) if text else ""


def decode(ids: np.ndarray, vocabulary: Pieces) -> str:
    """The marked text of ids, without the leading mark, marks turned into spaces."""
    by_byte = {i: bytes([b]) for b, i in vocabulary.byte.items()}
    raw = b"".join([by_byte[i] if i in by_byte else vocabulary.text[i].encode() for i in ids.tolist()])
    return raw.decode().removeprefix(MARK).replace(MARK, " ")


class Decoder:
    """The text of one document from its ids, chunk after chunk.  A character whose bytes lie on both
    sides of a chunk border comes with the later chunk."""

    def __init__(self, vocabulary: Pieces):
        self._raw, self._first = vocabulary.raw, True
        self._characters, self._digest = codecs.getincrementaldecoder("utf-8")(), hashlib.sha256()

    def chunk(self, ids: list[int], last: bool) -> str:
        raw = b"".join([self._raw[i] for i in ids])
        if self._first and raw:
            # the mark before a document is not part of it
            raw, self._first = raw.removeprefix(b" "), False
        self._digest.update(raw)
        return self._characters.decode(raw, last)

    def sha256(self) -> str:
        """Of the bytes of all chunks so far."""
        return self._digest.hexdigest()


PARTS = "key long, doc_id long, chunk long, chunks long, begin long, stop long, part string"
COUNTS = "doc_id long, chunk long, chunks long, n_ids long, ids binary"
TEXTS = "doc_id long, chunk long, chunks long, n_ids long, text string, decoded_sha256 string"
SUMMARY = "doc_id long, chunk long, chunks long, n_ids long, decoded_bytes long, ids_crc32 long, n_byte_ids long, decoded_sha256 string"
_STEP = 500
_HEAD = ["doc_id", "chunk", "chunks", "n_ids"]


def _head(rows: list[tuple[int, int, int, bytes]]) -> list[pa.Array]:
    return [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([len(r[3]) // 4 for r in rows], pa.int64())]


def _coded(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """Rows of COUNTS from (doc_id, chunk, chunks, ids)."""
    return pa.RecordBatch.from_arrays([*_head(rows), pa.array([r[3] for r in rows], pa.binary())], [*_HEAD, "ids"])


def _decoded(model: str | None, summary: bool):
    """Turns (doc_id, chunk, chunks, ids), a document's chunks in order, into rows of TEXTS or SUMMARY.
    Every Python stage of a plan is a process of its own, so short documents are decoded where they are encoded."""
    p = pieces(model)
    by_byte = np.zeros(p.library.get_piece_size(), bool)
    by_byte[list(p.byte.values())] = True
    decoder, due, document = None, 0, None

    def run(rows: list[tuple[int, int, int, bytes]], keys: list | None = None) -> pa.RecordBatch:
        nonlocal decoder, due, document
        texts, digests = [], []
        for k, (doc_id, chunk, chunks, ids) in enumerate(rows):
            key = keys[k] if keys else doc_id
            if not due:
                decoder, document = Decoder(p), key
            if chunk != due or key != document:
                raise ValueError(f"chunk {due} of {document} should come, not {chunk} of {key}")
            due = chunk + 1 if chunk + 1 < chunks else 0
            texts.append(decoder.chunk(np.frombuffer(ids, "<u4").tolist(), not due))
            digests.append(decoder.sha256())
        digests = pa.array(digests, pa.string())
        if not summary:
            return pa.RecordBatch.from_arrays([*_head(rows), pa.array(texts, pa.string()), digests], [*_HEAD, "text", "decoded_sha256"])
        more = [(len(t.encode()), zlib.crc32(r[3]), int(by_byte[np.frombuffer(r[3], "<u4")].sum())) for t, r in zip(texts, rows, strict=True)]
        columns = [pa.array([m[i] for m in more], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*_head(rows), *columns, digests], [*_HEAD, "decoded_bytes", "ids_crc32", "n_byte_ids", "decoded_sha256"])

    return run


def _decode(model: str | None, summary: bool):
    """Of sorted rows (key, doc_id, chunk, chunks, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _decoded(model, summary)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                key, *columns = (c.to_pylist() for c in batch.slice(at, _STEP).columns)
                yield make(list(zip(*columns, strict=True)), key)

    return run


def _split(size: int, margin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "chunk", "chunks", "begin", "stop", "part"]
        for batch in batches:
            rows = []
            for key, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = marked(text)
                n = max(1, -(-len(text) // size))
                for c in range(n):
                    lo, hi = c * size, min(len(text), (c + 1) * size)
                    left = max(0, lo - margin)
                    rows.append((key, doc_id, c, n, lo - left, hi - left, text[left : hi + margin]))
                    if sum(len(r[6]) for r in rows[-64:]) > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

    return run


def _whole(model: str | None, summary: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, make = pieces(model), _decoded(model, True) if summary else _coded
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                yield make([(doc_id, 0, 1, b"".join(map(p.word, _WORD.findall(marked(text))))) for doc_id, text in rows])

    return run


def _flat(m: np.ndarray) -> tuple[int, bytes]:
    return m.shape[0], m.astype("<f4").tobytes()


def _square(rows: int, weights: bytes) -> np.ndarray:
    return np.frombuffer(weights, "<f4").reshape(rows, -1)


WEIGHTS = "key long, run long, chunk long, rows long, weights binary"
RUNS = "key long, run long, rows long, weights binary"
ENDS = "key long, run long, entry long, exit long"
STATES = "key long, chunk long, entry long, exit long"


def _matrices(model: str | None, run_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for r in batch.to_pylist():
                rows, weights = _flat(Chunk(p, r["part"], r["begin"], r["stop"]).transfer())
                row = {"key": r["key"], "run": r["chunk"] // run_length, "chunk": r["chunk"], "rows": rows, "weights": weights}
                kinds = pa.schema([*((c, pa.int64()) for c in ("key", "run", "chunk", "rows")), ("weights", pa.binary())])
                yield pa.RecordBatch.from_pylist([row], kinds)

    return run


def _in_order(table: pa.Table, by: str) -> tuple[list[dict], list[np.ndarray]]:
    rows = sorted(table.to_pylist(), key=lambda r: r[by])
    return rows, [_square(r["rows"], r["weights"]) for r in rows]


def _run_product(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows, weights = _flat(product(_in_order(table, "chunk")[1]))
    return pa.table({"key": pa.array([key[0].as_py()]), "run": pa.array([key[1].as_py()]), "rows": pa.array([rows]), "weights": pa.array([weights], pa.binary())})


def _run_ends(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows, matrices = _in_order(table, "run")
    state = scan(matrices)
    return pa.table({
        "key": pa.array([key[0].as_py()] * len(rows), pa.int64()), "run": pa.array([r["run"] for r in rows], pa.int64()),
        "entry": pa.array(state[:-1], pa.int64()), "exit": pa.array(state[1:], pa.int64()),
    })


def _run_states(key: tuple[pa.Scalar, ...], weights: pa.Table, ends: pa.Table) -> pa.Table:
    rows, matrices = _in_order(weights, "chunk")
    (end,) = ends.to_pylist()
    state = scan(matrices, end["entry"], end["exit"])
    return pa.table({
        "key": pa.array([key[0].as_py()] * len(rows), pa.int64()), "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
        "entry": pa.array(state[:-1], pa.int64()), "exit": pa.array(state[1:], pa.int64()),
    })


def boundary_states(weights: DataFrame) -> DataFrame:
    """(key, chunk, entry, exit): the states on each document's best path, from WEIGHTS rows.

    Runs of chunks are multiplied in tasks of their own; a document's products, one per run, are
    scanned for the states between runs; then each run is scanned alone between its two states.
    """
    runs = weights.groupBy("key", "run").applyInArrow(_run_product, RUNS)
    ends = runs.groupBy("key").applyInArrow(_run_ends, ENDS)
    return weights.groupBy("key", "run").cogroup(ends.groupBy("key", "run")).applyInArrow(_run_states, STATES)


def _backtrace(model: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for r in batch.to_pylist():
                ids = Chunk(p, r["part"], r["begin"], r["stop"]).backtrace(r["entry"], r["exit"])
                row = _coded([(r["doc_id"], r["chunk"], r["chunks"], ids)])
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([r["key"]], pa.int64())], [*row.schema.names, "key"])

    return run


def encode_pieces(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, summary: bool = False, run: int = RUN) -> DataFrame:
    """Ids chunk by chunk: doc_id, chunk, chunks, n_ids, ids (little-endian 32-bit).

    A document's ids are those of its chunks in order.  Documents up to one chunk take one
    pass over their words; longer ones are split, scanned (in runs of `run` chunks) and
    backtraced.  The empty text has one chunk without ids.  Rows that repeat a doc_id are encoded
    each for itself.  summary: the ids are decoded again (see decode_pieces), and in their place
    stand decoded_bytes, ids_crc32, n_byte_ids and decoded_sha256.
    """
    schema = SUMMARY if summary else COUNTS
    margin = pieces(model).longest
    rows = documents(docs)
    short = rows.where(F.length("text") < chunk).mapInArrow(_whole(model, summary), schema)
    # the key tells repeated rows apart; the table fixes it
    split = rows.where(F.length("text") >= chunk).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    parts = stash(stash(split).mapInArrow(_split(chunk, margin), PARTS).repartition("key", "chunk"))
    weights = stash(parts.mapInArrow(_matrices(model, run), WEIGHTS))
    traced = parts.join(boundary_states(weights), ["key", "chunk"]).mapInArrow(_backtrace(model), COUNTS + ", key long")
    return short.union(decode_pieces(traced, model, "key", True) if summary else traced.drop("key"))


def decode_pieces(chunks: DataFrame, model: str | None = None, key: str = "doc_id", summary: bool = False) -> DataFrame:
    """The texts of chunk rows (doc_id, chunk, chunks, ids): doc_id, chunk, chunks, n_ids, text, decoded_sha256.

    A document's text is that of its chunks in order.  decoded_sha256 is of the text up to the end
    of the chunk, in the last one of the whole.  A document's chunks pass through one task in order,
    one batch at a time; none is held whole.  key: the column that tells documents apart, another one
    where a doc_id of several chunks repeats.  summary: in place of the text decoded_bytes,
    ids_crc32 and n_byte_ids.
    """
    rows = chunks.select(F.col(key).alias("key"), "doc_id", "chunk", "chunks", "ids")
    return rows.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_decode(model, summary), SUMMARY if summary else TEXTS)
