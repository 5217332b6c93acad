"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

The model file supplies pieces and scores; merging and decoding are done here.

Method.  Text is split where no piece can cross (before a run of U+2581, which
stands for the space), so every distinct fragment of a batch is merged once.  The
fragments' characters lie in one flat symbol array.  In each round every fragment
finds its best pair (a segmented minimum of ranks), all fragments merge that pair
at once, leftmost first and without overlaps, and the arrays are compacted; a
fragment without a pair leaves.  A fragment merges only the leftmost occurrence
in a round where a merge would open a better pair, so that the order is that of
one merge at a time.  Characters without a piece become byte pieces.

Edge cases: null text is empty (begin and end ids only; decodes to ""); NUL and
other control characters are ordinary characters; long texts are cut into
fragments, so memory follows the batch; extra columns pass through; a result
column replaces an input column of its name.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import extended, release, with_columns

SPACE = "▁"
NONE = np.int64(1) << 40
#: kinds of pieces in the model file: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
FRAGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE = 100_000
_models: dict[str, "Model"] = {}


def model(path: str) -> "Model":
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


class Model:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != 2 or not trained.byte_fallback or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and kept white space are handled")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined pieces are not handled")
        self.prefix = spec.add_dummy_prefix
        self.begin, self.end = trained.bos_id, trained.eos_id
        self.pieces = [p.piece for p in proto.pieces]
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece holds a space after another character")
        self.byte = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)])
        self.text = [b"" if p.type == CONTROL else b" \xe2\x81\x87 " if p.type == UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.encode().replace(SPACE.encode(), b" ") for p in proto.pieces]
        self.sizes = np.array([len(t) for t in self.text])
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.place = np.cumsum(self.sizes) - self.sizes
        self.is_byte = np.array([p.type == BYTE for p in proto.pieces])
        self.leading = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces])
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        scores = np.array([p.score for p in proto.pieces])
        order = np.unique(-scores, return_inverse=True)[1]  # equal scores share a rank: the leftmost goes first
        self.width = np.int64(len(self.pieces) + 1)
        keys = np.array([a * self.width + b for a, b, _ in pairs], np.int64)
        sort = np.argsort(keys)
        self.keys, made = keys[sort], np.array([i for *_, i in pairs], np.int64)[sort]
        size = 1 << int(len(keys) * 4 - 1).bit_length()
        self.mask = np.int64(size - 1)
        self.made, self.rank = made, order[made].astype(np.int64)
        self._table(size)
        self.cache: dict[str, bytes] = {}

    def _table(self, size):
        """Open addressing: slot -> number of the pair, -1 where free."""
        self.slots = np.full(size, -1, np.int64)
        left, at = np.arange(len(self.keys)), self._slot(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several, the last stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _slot(self, keys):
        return ((keys * np.int64(0x9E3779B97F4A7C1 | 1)) >> np.int64(20)) & self.mask

    def pair(self, a, b):
        """Number of each pair (a, b), -1 where they make no piece."""
        keys = a * self.width + b
        at, out, todo = self._slot(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(todo):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[todo])
            out[todo[hit]] = got[hit]
            on = (got >= 0) & ~hit
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out

    def ranks(self, a, b):
        got = self.pair(a, b)
        return np.where(got >= 0, self.rank[got], NONE), got

    def merge(self, symbols: np.ndarray, owner: np.ndarray, count: int):
        """Final symbols of each fragment. symbols: flat ids, len(pieces) for none; owner: fragment of each, ascending."""
        out_s, out_o = [], []
        none = self.width - 1

        def ranked(s, o):
            r, p = np.full(len(s), NONE), np.full(len(s), -1, np.int64)
            if len(s) > 1:
                inner = np.flatnonzero((o[1:] == o[:-1]) & (s[1:] != none) & (s[:-1] != none))
                r[inner], p[inner] = self.ranks(s[inner], s[inner + 1])
            return r, p

        s, o = symbols, owner
        r, p = ranked(s, o)
        while len(s):
            starts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(s)]]))
            best = np.minimum.reduceat(r, starts)
            alive = best < NONE
            if not alive.all():
                gone = np.repeat(~alive, sizes)
                out_s.append(s[gone]), out_o.append(o[gone])
                s, o, r, p = (x[~gone] for x in (s, o, r, p))
                starts_n = sizes[alive]
                best, sizes = best[alive], starts_n
                if not len(s):
                    break
            hit = np.flatnonzero(r == np.repeat(best, sizes))
            # leftmost first without overlaps: of a chain of neighbouring hits every second, from its first
            chain = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            first = np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - first) % 2 == 0
            hit = hit[take]
            piece = self.made[p[hit]]
            # would a merge open a pair that is no worse? then its fragment merges its leftmost only
            rank, mine = r[hit], o[hit]
            worse = np.zeros(len(hit), bool)
            for other, made_first in ((hit - 1, False), (hit + 2, True)):
                ok = (other >= 0) & (other < len(s))
                ok[ok] &= o[other[ok]] == mine[ok]
                k = np.flatnonzero(ok)
                k = k[s[other[k]] != none]
                a, b = (piece[k], s[other[k]]) if made_first else (s[other[k]], piece[k])
                worse[k] |= self.ranks(a, b)[0] <= rank[k]
            next_to = np.flatnonzero((hit[1:] == hit[:-1] + 2) & (mine[1:] == mine[:-1]))
            worse[next_to] |= self.ranks(piece[next_to], piece[next_to + 1])[0] <= rank[next_to]
            if worse.any():
                lone = np.zeros(count, bool)
                lone[mine[worse]] = True
                keep = ~lone[mine] | np.concatenate([[True], mine[1:] != mine[:-1]])
                hit, piece = hit[keep], piece[keep]
            s = s.copy()
            s[hit] = piece
            stay = np.ones(len(s), bool)
            stay[hit + 1] = False
            fresh = np.zeros(len(s), bool)
            fresh[hit] = True
            back = hit - 1
            back = back[back >= 0]
            # the neighbour on the left may itself have gone: its left part holds the pair now
            fresh[back] = True
            back2 = hit - 2
            fresh[back2[back2 >= 0]] = True
            s, o, r, p, fresh = (x[stay] for x in (s, o, r, p, fresh))
            k = np.flatnonzero(fresh)
            r[k], p[k] = NONE, -1
            k = k[k + 1 < len(s)]
            k = k[(o[k] == o[k + 1]) & (s[k] != none) & (s[k + 1] != none)]
            r[k], p[k] = self.ranks(s[k], s[k + 1])
        s, o = np.concatenate(out_s) if out_s else symbols, np.concatenate(out_o) if out_o else owner
        order = np.argsort(o, kind="stable")
        return s[order], o[order]

    def fragments(self, words: list[str]) -> list[bytes]:
        """Piece ids of each fragment, as little-endian 32-bit integers."""
        if not words:
            return []
        text = "".join(words)
        sizes = np.array([len(w) for w in words])
        get, none = self.chars.get, int(self.width - 1)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        distinct, back = np.unique(points, return_inverse=True)
        symbols = np.array([get(chr(c), none) for c in distinct.tolist()], np.int64)[back]
        owner = np.repeat(np.arange(len(words)), sizes)
        if (symbols == none).any():
            symbols = np.where(symbols == none, none + 1 + points.astype(np.int64), symbols)  # keeps the character
            plain = np.minimum(symbols, none)
            lost = points[symbols > none]
            s, o = self.merge(plain, owner, len(words))
            s = s.astype(np.int64)
            # characters without a piece come through in order: spell them in bytes
            spelled = [[int(self.byte[b]) for b in chr(c).encode("utf-8", "surrogatepass")] for c in lost.tolist()]
            at = np.flatnonzero(s == none)
            reps = np.ones(len(s), np.int64)
            reps[at] = [len(x) for x in spelled]
            o = np.repeat(o, reps)
            first = np.cumsum(reps) - reps
            s = np.repeat(s, reps)
            for a, x in zip(first[at], spelled):
                s[a : a + len(x)] = x
        else:
            s, o = self.merge(symbols, owner, len(words))
        raw = s.astype("<u4").tobytes()
        cut = (np.searchsorted(o, np.arange(len(words) + 1)) * 4).tolist()
        return [raw[a:z] for a, z in zip(cut, cut[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, with the begin and end ids."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        split = []
        for t in texts:
            t = (t or "").replace(" ", SPACE)
            split.append(FRAGMENT.findall(SPACE + t if t and self.prefix else t))
        new = list({w for ws in split for w in ws if w not in self.cache}) if split else []
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            self.cache.update(zip(part, self.fragments(part)))
        head, tail = (int(i).to_bytes(4, "little") for i in (self.begin, self.end))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join([head, *map(get, ws), tail]), "<u4") for ws in split]

    def decode(self, many: list[np.ndarray]) -> list[bytes]:
        """UTF-8 text of each id sequence, as the library has it: bytes that are no UTF-8 become U+FFFD one by one."""
        if not many:
            return []
        ids = np.concatenate(many).astype(np.int64)
        owner = np.repeat(np.arange(len(many)), [len(x) for x in many])
        shown = self.sizes[ids] > 0
        ids, owner = ids[shown], owner[shown]
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        raw = self.flat[np.repeat(self.place[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cut = np.searchsorted(owner, np.arange(len(many) + 1))
        at = np.concatenate([[0], ends])[cut].tolist()
        spelled = np.concatenate([[0], np.cumsum(self.is_byte[ids])])[cut]
        out = []
        for k in range(len(many)):
            text = raw[at[k] : at[k + 1]]
            if spelled[k + 1] > spelled[k] and not _is_utf8(text):
                text = self._with_bytes(ids[cut[k] : cut[k + 1]])
            out.append(text[1:] if self.prefix and cut[k + 1] > cut[k] and self.leading[ids[cut[k]]] else text)
        return out

    def _with_bytes(self, ids):
        parts, run, text = [], bytearray(), self.text
        for i, byte in zip(ids.tolist(), self.is_byte[ids].tolist()):
            if byte:
                run += text[i]
            else:
                if run:
                    parts.append(_spelled(bytes(run)))
                    run = bytearray()
                parts.append(text[i])
        parts.append(_spelled(bytes(run)))
        return b"".join(parts)


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _spelled(raw: bytes) -> bytes:
    if _is_utf8(raw):
        return raw
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[i : i + size].decode()
            except UnicodeDecodeError:
                continue
            if i + size <= len(raw):
                out.append(raw[i : i + size])
                i += size
                break
        else:
            out.append(b"\xef\xbf\xbd")
            i += 1
    return b"".join(out)


def tokenized(df: DataFrame, path: str, text_col: str = "text", digest: bool = False) -> DataFrame:
    """df with n_tokens, ids and decoded; with digest, ids_sha256 and decoded_sha256 in place of the two."""
    more = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digest else {"n_tokens": "long", "ids": T.ArrayType(T.IntegerType()), "decoded": "string"}
    out = extended(df.schema, **more)

    def work(batches):
        m = model(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes) // (1 << 20)
            for a, z in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])))) if len(sizes) else ():
                part = batch.slice(a, z - a)
                ids = m.encode(part.column(text_col).to_pylist())
                texts = m.decode(ids)
                cols = {"n_tokens": pa.array([len(i) for i in ids], pa.int64())}
                if digest:
                    cols["ids_sha256"] = pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string())
                    cols["decoded_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                else:
                    cols["ids"] = pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))
                    cols["decoded"] = pa.array(texts, pa.binary()).cast(pa.string())
                yield with_columns(part, **cols)
        m.cache.clear()
        release()

    return df.mapInArrow(work, out)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: per document the number of ids and digests of the ids and of the decoded text."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenized(docs, default_path(), digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
