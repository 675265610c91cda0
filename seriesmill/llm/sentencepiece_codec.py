"""SentencePiece models encoded and decoded by the tokenizers library.

The model's protobuf is parsed and rebuilt: its normaliser, the metaspace
marker, the pieces with their scores (a unigram model, or the merges that a BPE
model's scores imply), and byte fallback.  Where no piece holds a marker after
another character, texts are cut before each run of markers: a piece never spans
a cut, so each distinct word is encoded once, in multithreaded batches.

Parity with the sentencepiece library is verified.  Where the model leaves characters as
they are, word by word: every distinct word is encoded by both, and a text agrees if all
of its words do.  Where it maps characters, each whole text as it was given is encoded by the other library, with
its own normaliser.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import byte_slices, release

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct words that a worker remembers at most.
WORD_MEMO = 500_000


def _rebuild(proto):
    """A tokenizers.Tokenizer of the same pieces; it expects normalised text."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    pieces = list(proto.pieces)
    fallback = proto.trainer_spec.byte_fallback
    unk = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
    if proto.trainer_spec.model_type == 1:  # unigram
        # Pieces that encoding never yields keep their numbers at a hopeless score.
        low = min((p.score for p in pieces), default=0.0) - 1e6
        model = models.Unigram([(p.piece, p.score if p.type in (NORMAL, USER) else low) for p in pieces], unk_id=unk, byte_fallback=fallback)
    elif proto.trainer_spec.model_type == 2:  # BPE
        vocab = {p.piece: i for i, p in enumerate(pieces)}
        score = {p.piece: p.score for p in pieces if p.type in (NORMAL, USER)}
        merges = []
        for whole, s in score.items():
            cuts = [(whole[:k], whole[k:]) for k in range(1, len(whole)) if whole[:k] in score and whole[k:] in score]
            merges += [(-s, vocab[whole], vocab[a], vocab[b], a, b) for a, b in cuts]
        merges.sort(key=lambda m: m[:4])
        model = models.BPE(vocab=vocab, merges=[m[4:] for m in merges], unk_token=pieces[unk].piece, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"model type {proto.trainer_spec.model_type} is neither unigram nor BPE")
    out = Tokenizer(model)
    if users := [AddedToken(p.piece, normalized=False) for p in pieces if p.type == USER]:
        out.add_tokens(users)
    strip = [decoders.Strip(" ", 1, 0)] if proto.normalizer_spec.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


def _rules(charsmap: bytes) -> dict[str, str]:
    """The rules of a precompiled character map: what is replaced, and by what.

    The map is a double-array trie over UTF-8 bytes, whose values are places in a block of
    strings that end with a zero byte.  All of its paths are followed, a byte at a time for all together.
    """
    size = int.from_bytes(charsmap[:4], "little")
    units, strings = np.frombuffer(charsmap, np.uint32, size // 4, 4).astype(np.int64), charsmap[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    places, keys, out = np.array([offset(units[0])]), [b""], {}
    while len(places):
        to = places[:, None] ^ np.arange(1, 256)
        inside = to < len(units)
        which, byte = np.nonzero(inside & ((units[np.where(inside, to, 0)] & 0x800000FF) == np.arange(1, 256)))
        byte += 1
        unit = units[places[which] ^ byte]
        keys = [keys[w] + bytes([b]) for w, b in zip(which.tolist(), byte.tolist(), strict=True)]
        places = (places[which] ^ byte) ^ offset(unit)
        for k in np.flatnonzero(unit >> 8 & 1).tolist():
            at = int(units[places[k]] & 0x7FFFFFFF)
            out[keys[k].decode()] = strings[at : strings.index(b"\0", at)].decode()
    return out


class CharacterMap:
    """Replaces the longest rule at each place from left to right; characters without a rule stay."""

    def __init__(self, charsmap: bytes, fixed: list[str]):
        rules = _rules(charsmap)
        self.single = str.maketrans({k: v for k, v in rules.items() if len(k) == 1})
        self.longer = {k: v for k, v in rules.items() if len(k) > 1}
        self.lengths = sorted({len(k) for k in self.longer}, reverse=True)
        seconds = "".join(map(re.escape, sorted({k[1] for k in self.longer})))
        #: Where a rule of several characters may start: before one of their second characters.
        self.starts = re.compile(f"(?s:.)(?=[{seconds}])") if seconds else None
        #: The model's own symbols are left as they are.
        self.fixed = re.compile("(" + "|".join(map(re.escape, sorted(fixed, key=len, reverse=True))) + ")") if fixed else None

    def normalize_str(self, text: str) -> str:
        if self.fixed is None:
            return self._mapped(text)
        parts = self.fixed.split(text)
        return "".join(part if i % 2 else self._mapped(part) for i, part in enumerate(parts))

    def _mapped(self, text: str) -> str:
        out, at = [], 0
        for m in self.starts.finditer(text) if self.starts else ():
            if (p := m.start()) >= at:
                for n in self.lengths:
                    if (to := self.longer.get(text[p : p + n])) is not None and len(text) >= p + n:
                        out += [text[at:p].translate(self.single), to]
                        at = p + n
                        break
        out.append(text[at:].translate(self.single))
        return "".join(out)


class Codec:
    """Encodes and decodes as the model at ``path`` says; built once in each worker."""

    def __init__(self, path: str, threads: int = 1, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.spec, self.threads = proto.normalizer_spec, threads
        users = [p.piece for p in proto.pieces if p.type == USER]
        self.charsmap = CharacterMap(self.spec.precompiled_charsmap, users) if self.spec.precompiled_charsmap else None
        self.model = _rebuild(proto)
        spans = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type in (NORMAL, USER))
        # A user-defined piece may match anywhere, across a cut too.
        self.cut = None if spans or any(p.type == USER for p in proto.pieces) else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.reference = SentencePieceProcessor(model_file=path) if verify else None
        self.memo: dict[str, bytes] = {}
        #: Words that the libraries encode differently, and that decoding does not give back.
        self.unequal: set[str] = set()
        self.lossy: set[str] = set()

    def forget(self) -> None:
        for held in (self.memo, self.unequal, self.lossy):
            held.clear()

    def normalise(self, text: str) -> str:
        """What the pieces are matched against: markers for spaces, one in front if the model says so."""
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.spec.remove_extra_whitespaces:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if text and self.spec.add_dummy_prefix:
            text = " " + text
        if not self.spec.escape_whitespaces:
            return text
        text = text.replace(" ", MARK)
        # Space at the end is dropped last, so markers of the text itself go with it.
        return text.rstrip(MARK) if self.spec.remove_extra_whitespaces else text

    def _plain(self, words: list[str]) -> list[str]:
        """The words with spaces for markers, without the one that the model adds in front.

        All in two replacements where no word holds the character that parts them.
        """
        front = "\x00 " if self.spec.add_dummy_prefix else "\x00"
        out = ("\x00" + "\x00".join(words)).replace(MARK, " ").replace(front, "\x00").split("\x00")[1:]
        if len(out) != len(words):
            out = [w.replace(MARK, " ").removeprefix(front[1:]) for w in words]
        return out

    def _reference_ids(self, words: list[str], plain: list[str]) -> list[list[int]]:
        """The other library's ids; it adds the marker in front by itself.

        A word without a marker in front occurs only where the model adds none.
        """
        out = self.reference.encode(plain, num_threads=self.threads)
        if MARK in words:  # an empty text, to which no marker is added
            out[words.index(MARK)] = [self.reference.piece_to_id(MARK)]
        return out

    def _learn(self, words: list[str]) -> None:
        ids = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        data = np.fromiter(chain.from_iterable(ids), np.int32).tobytes()
        ends = (4 * np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))).tolist()
        self.memo.update(zip(words, [data[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        plain = self._plain(words)
        # Whole lists are compared at once: they differ rarely.
        if self.reference is not None and self.charsmap is None and (other := self._reference_ids(words, plain)) != ids:
            self.unequal.update(w for w, i, o in zip(words, ids, other, strict=True) if i != o)
        if (back := self.decode(ids)) != plain:
            self.lossy.update(w for w, t, p in zip(words, back, plain, strict=True) if t != p)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Ids of each text, whether both libraries agree on it, and whether decoding gives
        the normalised text back; null is empty.  The other library gets the text as it is wherever characters are mapped.

        Decoding a text joins what its words decode to: bytes of one character are never parted
        by a cut, so the words' verdicts are the text's.
        """
        cut = [self.cut.findall(n) if self.cut else [n] * bool(n) for n in (self.normalise(t or "") for t in texts)]
        seen = set().union(*cut)
        missing = seen - self.memo.keys()
        if len(self.memo) + len(missing) > WORD_MEMO:
            self.forget()
            missing = seen
        if missing:
            self._learn(list(missing))
        ids = [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.int32) for words in cut]
        back = [not self.lossy or self.lossy.isdisjoint(words) for words in cut]
        if self.reference is not None and self.charsmap is not None:
            other = self.reference.encode([t or "" for t in texts], num_threads=self.threads)
            return ids, [i.tolist() == o for i, o in zip(ids, other, strict=True)], back
        return ids, [not self.unequal or self.unequal.isdisjoint(words) for words in cut], back

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode_batch(ids, skip_special_tokens=False)


_CODECS: dict[tuple, Codec] = {}


def codec_at(path: str, threads: int) -> Codec:
    """The worker's codec: built once, its memory of words is cleared after each task."""
    key = (path, os.path.getmtime(path), threads)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(path, threads)
    return _CODECS[key]


def encode_documents(docs: DataFrame, model: str, *, threads: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, ids, n_tokens, ids_sha256, round_trip, parity)`` for every row.

    ``ids`` are the text's token ids without begin or end tokens; a null text is
    encoded as the empty one, which has none.  ``ids_sha256`` is the digest of the ids as
    little-endian 32-bit numbers.  ``round_trip``: decoding gives the normalised text
    back.  ``parity``: sentencepiece gives the same ids.  Null and repeated ids are kept,
    a row each; texts are taken whole, however long, a table without rows gives none, and columns may have any names;
    nothing is shuffled.  The model file must be at the same path on
    every executor.
    """
    types = dict(docs.dtypes)
    columns = [id_col, *keep]
    schema = ", ".join([*(f"`c{i}` {types[c]}" for i, c in enumerate(columns)), "ids array<int>, n_tokens bigint, ids_sha256 string, round_trip boolean, parity boolean"])
    names = [*(f"c{i}" for i in range(len(columns))), "ids", "n_tokens", "ids_sha256", "round_trip", "parity"]

    def run(batches):
        codec = codec_at(model, threads)
        gc.disable()  # lists of ids by the hundred thousand, none in a cycle
        try:
            for batch in batches:
                for lo, hi in byte_slices(batch.column(batch.num_columns - 1), 2 << 20):
                    part = batch.slice(lo, hi - lo)
                    ids, parity, back = codec.encode(part.column(part.num_columns - 1).to_pylist())
                    lengths = np.array([len(i) for i in ids], np.int64)
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    digests = [hashlib.sha256(i.tobytes()).hexdigest() for i in ids]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(lengths), pa.array(digests), pa.array(back, pa.bool_()), pa.array(parity, pa.bool_())], names=names)
        finally:
            gc.enable()
            codec.forget()
            release()

    out = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "ids", "n_tokens", "ids_sha256", "round_trip", "parity")
