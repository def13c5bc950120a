"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word is a row of symbols. The leaves of its tree hold ``rank * width + place`` of every
mergeable adjacent pair, so the root is the leftmost pair of the lowest rank. A merge changes
three leaves, each repaired in a logarithmic number of steps; a word is done when its root is
empty. Words of like length form one matrix and take each step together; longer words than that
pays for take the same steps alone.

Model files are of the tokenizers library (``BPE`` with an end-of-word suffix and byte symbols).
They are read once on the driver and travel with the tasks; a vocabulary has a fixed size.
"""

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from casework.llm.arrow import sliced

#: Cells of one matrix of symbols, and the longest words that go into one.
CELLS, WIDEST = 1 << 16, 64
#: Chunks of text whose ids a task remembers before it starts again.
REMEMBERED = 600_000
#: Texts within these characters need no tables of newer Unicode versions.
PLAIN = re.compile("[^\x00-\x1b -ɏ‐-‧€]")


def byte_letters():
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Bpe:
    """A model file as arrays, with the texts and ids of its special tokens."""

    def __init__(self, content: str):
        model = json.loads(content)
        vocab, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.plain = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        codes = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        codes, first = np.unique(codes[::-1], return_index=True)
        rank = len(pairs) - 1 - first  # the last of equal pairs counts
        self.codes, self.rank, self.made = codes, rank, made[rank]
        self.by_rank = made
        self.tokens = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {}
        for t in model["added_tokens"]:
            self.special[t["content"]] = t["id"]
            self.tokens += [""] * (t["id"] + 1 - len(self.tokens))
            self.tokens[t["id"]] = t["content"]
        self.split = next(
            p["pattern"]["Regex"] for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"
        )
        self.content = content

    def ranks(self, a, b):
        """Rank of each pair, or -1."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.rank[at], -1)

    def merge_rows(self, symbols, lengths):
        """Ids of many words: ``symbols`` is a matrix, short words are filled up with -1."""
        n, width = symbols.shape
        none, full = np.int32(np.iinfo(np.int32).max), 2 * width
        tree = np.full((n, full), none, np.int32)
        place = np.arange(width, dtype=np.int64)
        rank = self.ranks(symbols[:, :-1], symbols[:, 1:])
        tree[:, width:-1] = np.where(rank >= 0, rank * width + place[:-1], none)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        # Neighbours; place ``width`` is the outside. 
        step = width + 1
        after = np.broadcast_to(np.append(place + 1, width), (n, step)).copy()
        after[:, :width][place + 1 >= lengths[:, None]] = width
        before = np.broadcast_to(np.append(place - 1, width), (n, step)).copy()
        before[:, 0] = width
        wide = np.concatenate([symbols, np.full((n, 1), -1, np.int64)], axis=1)
        tree, after, before, wide = tree.ravel(), after.ravel(), before.ravel(), wide.ravel()
        rows = np.flatnonzero(tree[1::full] < none)
        while len(rows):
            at, root = rows * step, tree[rows * full + 1].astype(np.int64)
            left, rank = root % width, root // width
            right = after[at + left]
            beyond, behind = after[at + right], before[at + left]
            wide[at + left] = merged = self.by_rank[rank]
            wide[at + right] = -1
            after[at + left] = beyond
            before[at + beyond] = left
            found = self.ranks(
                np.concatenate([merged, wide[at + behind]]), np.concatenate([wide[at + beyond], merged])
            )
            leaf = np.concatenate([left, behind])
            value = np.where(found >= 0, found * width + leaf, none).astype(np.int32)
            # The changed leaves: right is empty, left and the one behind have new pairs. If nothing
            # is behind, right stands in its place.
            outside = behind == width
            m = len(rows)
            value[m:][outside] = none
            nodes = np.stack([right, left, np.where(outside, right, behind)]) + width
            base = np.broadcast_to(rows * full, (3, m))
            tree[base[0] + nodes[0]] = none
            tree[base[1] + nodes[1]] = value[:m]
            tree[base[2] + nodes[2]] = value[m:]
            size = width
            while size > 1:
                nodes >>= 1
                child = base + 2 * nodes
                tree[base + nodes] = np.minimum(tree[child], tree[child + 1])
                size >>= 1
            rows = rows[tree[rows * full + 1] < none]
        kept = wide.reshape(n, step)[:, :width]
        return kept[kept >= 0], (kept >= 0).sum(axis=1)

    def merge_long(self, symbols):
        """Ids of one long word, by the same tree."""
        lookup = getattr(self, "table", None)
        if lookup is None:
            lookup = self.table = dict(zip(self.codes.tolist(), self.rank.tolist()))
        n = len(symbols)
        width = 1 << max(1, (n - 1).bit_length())
        none, sym = 1 << 60, symbols.tolist()
        first = self.ranks(symbols[:-1], symbols[1:])
        leaves = np.full(width, none, np.int64)
        leaves[: n - 1] = np.where(first >= 0, first * width + np.arange(n - 1), none)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
        tree = [none] + [x for level in reversed(levels) for x in level.tolist()]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def put(leaf, value):
            node = width + leaf
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < none:
            rank, left = divmod(tree[1], width)
            right = after[left]
            beyond = after[right]
            sym[left], sym[right] = int(self.by_rank[rank]), -1
            after[left] = beyond
            if beyond >= 0:
                before[beyond] = left
            put(right, none)
            for a, b in ((left, beyond), (before[left], left)):
                if a >= 0:
                    found = lookup.get(sym[a] << 32 | sym[b]) if b >= 0 else None
                    put(a, none if found is None else found * width + a)
        return [s for s in sym if s >= 0]

    def encode_words(self, words):
        """Ids of each word, as the bytes of 32-bit integers; words are non-empty strings."""
        raw = [w.encode() for w in words]
        out = [b""] * len(raw)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        for width in (1, 2, 4, 8, 16, 32, WIDEST):
            chosen = np.flatnonzero((lengths <= width) & (lengths > width // 2))
            for start in range(0, len(chosen), CELLS // width):
                part = chosen[start : start + CELLS // width]
                size = lengths[part]
                data = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)
                symbols = np.full((len(part), width), -1, np.int64)
                symbols[np.arange(width) < size[:, None]] = self.plain[data]
                symbols[np.arange(len(part)), size - 1] = self.last[data[np.cumsum(size) - 1]]
                ids, counts = (symbols[:, 0], size) if width == 1 else self.merge_rows(symbols, size)
                ids, end = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
                for i, a, b in zip(part.tolist(), [0, *end], end):
                    out[i] = ids[a:b]
        for i in np.flatnonzero(lengths > WIDEST).tolist():
            data = np.frombuffer(raw[i], np.uint8)
            symbols = self.plain[data]
            symbols[-1] = self.last[data[-1]]
            out[i] = np.array(self.merge_long(symbols), np.int32).tobytes()
        return out


class Encoder:
    """Texts to ids and back, remembering what its task has met between white space."""

    def __init__(self, model: Bpe):
        self.model, self.library = model, None
        self.find = regex.compile(model.split).findall
        self.special = {t: np.int32(i).tobytes() for t, i in model.special.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) + ")")
        self.forget()

    def forget(self):
        self.words, self.chunks = {}, {}

    def split(self, chunk):
        """Words of a normalised text without white space, or of any text beyond PLAIN."""
        if PLAIN.search(chunk) is None:
            return self.find(chunk)
        if self.library is None:  # its normaliser and splitter, for scripts whose tables may differ
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.model.content)
            self.back = {c: b for b, c in byte_letters().items()}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(map(self.back.__getitem__, w)).decode() for w, _ in found]

    def pieces(self, text):
        """What a text consists of: chunks between white space and special tokens."""
        if self.special and "<" in text:
            parts = self.marks.split(text)
            if len(parts) > 1:
                return [p for part in parts for p in ([part] if part in self.special else self.pieces(part))]
        if PLAIN.search(text) is None:
            return unicodedata.normalize("NFC", text).lower().split()
        return [text]

    def encode(self, texts):
        """Ids of every text, as the bytes of 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        met = set().union(*split)
        if len(self.chunks) + len(met) > REMEMBERED:
            self.forget()
        new = [c for c in met.difference(self.chunks) if c not in self.special]
        words = [self.split(c) for c in new]
        unknown = list(set().union(*words).difference(self.words))
        self.words.update(zip(unknown, self.model.encode_words(unknown)))
        one = self.words.__getitem__
        self.chunks.update((c, one(w[0]) if len(w) == 1 else b"".join(map(one, w))) for c, w in zip(new, words))
        self.chunks.update(self.special)
        of = self.chunks.__getitem__
        return [b"".join(map(of, s)) for s in split]

    def decode(self, ids):
        """Text of ids, special tokens included: this kind of model has no decoder, so the tokens
        stand as they are, with a blank between."""
        return " ".join(map(self.model.tokens.__getitem__, ids))


def load(path: str) -> Bpe:
    """Model from a file on the driver."""
    with open(path, encoding="utf-8") as f:
        return Bpe(f.read())


def tokenized(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = "decoded") -> DataFrame:
    """``docs`` with the ids of every whole text and, unless ``decoded_col`` is None, their decoded text.

    A null or empty text gives no ids and an empty decoded text. Columns of the same names are
    replaced; all others, and repeated rows, stay as they are. No row depends on another, so an
    executor that is lost costs its own tasks only.
    """
    added = [c for c in (ids_col, decoded_col) if c]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in {a.lower() for a in added}])
    shipped = docs.sparkSession.sparkContext.broadcast(load(path).content)
    fields = list(docs.schema.fields) + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.StringType()))

    def run(batches):
        encoder = Encoder(Bpe(shipped.value))
        for whole in batches:
            for batch in sliced(whole):
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                raw = encoder.encode(texts)
                ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
                ids = np.frombuffer(b"".join(raw), np.int32)
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                if decoded_col:
                    whole, ends = ids.tolist(), ends.tolist()
                    columns.append(pa.array([encoder.decode(whole[a:b]) for a, b in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))
