"""Byte-level BPE encoding of whole texts through the ``tokenizers`` library.

The pre-tokenizer of a byte-level BPE never lets a piece run over a single blank
or line feed that stands between two non-space characters: the blank joins the
piece at its right, the line feed is a piece of its own.  A text may therefore be
cut at those places, and equal parts always get equal ids.  Arrow finds the
distinct parts of a batch, the library encodes each once, many joined in one string,
and a bounded dictionary remembers the ids for later batches.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import give_back

#: Every character that any regex engine may take for white space.
_SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[ \n][^{_SPACE}])")
_RE2 = re.sub(r"\\u(....)", r"\\x{\1}", _SPACE).replace(r"\x85", r"\x{85}").replace(r"\xa0", r"\x{a0}")
#: Other white space at a blank or line feed, or at an end; the mark of a text's first part.
_UNEVEN = rf"[{_RE2}][ \n]|[ \n][{_RE2}]|\A[{_RE2}]|[{_RE2}]\z|\x00"
_FIRST = "\x00"
_MARKS = ".,;:!?%$&*#|)]\"'"

#: Parts remembered per worker; further parts are encoded once a batch.
CACHE_PARTS = 400_000
#: Longer parts are not remembered.
CACHE_CHARS = 64
#: Parts that the library gets as one string.
RUN = 256
#: Bytes of text encoded at once.
BATCH_BYTES = 2_000_000


class Encoder:
    """``encode(texts)`` gives one numpy array of ids for each text."""

    def __init__(self, tokenizer_path: str, cache_parts: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(tokenizer_path)
        small = self._tok.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self._code = "H" if small else "I"
        self.dtype = np.dtype("<u2" if small else "<u4")
        self._added = [t.content for t in self._tok.get_added_tokens_decoder().values() if t.content]
        self._cache: dict[str, bytes] = {}
        self._room = cache_parts
        probe = "one two,\nthree  four\n\nfive"
        self._cuttable = (
            type(self._tok.pre_tokenizer).__name__ == "ByteLevel"
            and self._tok.normalizer is None
            and self._plain([probe])[0] == b"".join(self._plain(_CUT.split(probe)))
        )
        # ids whose token begins with a blank or a line feed, in the alphabet of byte-level tokens
        vocab = self._tok.get_vocab(with_added_tokens=True)
        self._begins = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self._begins[[i for x, i in vocab.items() if x[:1] in ("\u0120", "\u010a")]] = True
        self._joinable = self._cuttable and not any(" " in a or "\n" in a for a in self._added)

    def _plain(self, texts: list[str]) -> list[bytes]:
        code = self._code
        return [array(code, e.ids).tobytes() for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, parts: list[str]) -> list[bytes]:
        """As ``_plain``, of parts that each begin with the only blank or line feed in them."""
        if not self._joinable or not parts:
            return self._plain(parts)
        runs = ["".join(parts[i : i + RUN]) for i in range(0, len(parts), RUN)]
        ids = np.concatenate([np.array(e.ids, dtype=self.dtype) for e in self._tok.encode_batch_fast(runs, add_special_tokens=False)])
        at = np.flatnonzero(self._begins[ids])
        if len(at) != len(parts):
            return self._plain(parts)
        flat, cuts = ids.tobytes(), [*(at * self.dtype.itemsize).tolist(), ids.nbytes]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _parts(self, names: list[str]) -> list[bytes]:
        """Ids of distinct parts: behind a blank, or with their own line feed, or first."""
        cache = self._cache
        found = list(map(cache.get, names))
        missing = [i for i, x in enumerate(found) if x is None]
        if not missing:
            return found
        stems, ends = {}, {}
        for i in missing:
            x = names[i]
            stem = x.rstrip(_MARKS)
            # between a letter and a punctuation mark a new piece always begins
            if stem != x and stem and stem[-1].isalpha():
                ends[i] = stem
                x = stem
                if x in cache:
                    continue
            stems[x] = b""
        new = list(stems)
        marks = list({names[i][len(stem) :] for i, stem in ends.items()})
        firsts = [x for x in new if x[:1] == _FIRST]
        later = [x for x in new if x[:1] != _FIRST] if firsts else new
        ids = self._plain([x[1:] for x in firsts] + marks)
        mark = dict(zip(marks, ids[len(firsts) :], strict=True))
        stems.update(zip(firsts, ids, strict=False))
        stems.update(zip(later, self._runs([x if x[:1] == "\n" else " " + x for x in later]), strict=True))
        for i in missing:
            if i in ends:
                stem = ends[i]
                found[i] = (stems[stem] if stem in stems else cache[stem]) + mark[names[i][len(stem) :]]
            else:
                found[i] = stems[names[i]]
        if self._room > 0:
            stay = [x for x in new if len(x) <= CACHE_CHARS][: self._room]
            self._room -= len(stay)
            cache.update((x, stems[x]) for x in stay)
        return found

    def _even(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts whose white space is single blanks and line feeds between other characters."""
        marked = pc.replace_substring(pc.binary_join_element_wise(_FIRST, texts, ""), "\n", " \n")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        ids = self._parts(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.dtype.itemsize
        flat, begin = np.frombuffer(b"".join(ids), dtype=self.dtype), np.concatenate([[0], np.cumsum(size)[:-1]])
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(ends[-1], dtype=np.int32) + np.repeat((begin[which] - ends[:-1]).astype(np.int32), n)
        out = flat[at]
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, _UNEVEN) if self._cuttable else pa.array([True] * len(texts))
        for a in self._added:
            uneven = pc.or_(uneven, pc.match_substring(texts, a))
        uneven = pc.and_(uneven, pc.not_equal(texts, ""))
        single = pc.indices_nonzero(uneven).to_pylist()
        if not single:
            return self._even(texts) if len(texts) else []
        out: list = [None] * len(texts)
        rest = pc.invert(uneven)
        even = texts.filter(rest)
        if len(even):
            for i, a in zip(pc.indices_nonzero(rest).to_pylist(), self._even(even), strict=True):
                out[i] = a
        for i in single:
            t = texts[i].as_py()
            whole = not self._cuttable or any(a in t for a in self._added)
            parts = self._plain([t] if whole else list(dict.fromkeys(p := _CUT.split(t))))
            if not whole:
                known = dict(zip(dict.fromkeys(p), parts, strict=True))
                parts = [known[x] for x in p]
            out[i] = np.frombuffer(b"".join(parts), dtype=self.dtype)
        return out


_made: dict[str, Encoder] = {}


def encoder(tokenizer_path: str) -> Encoder:
    """One encoder per worker process and file."""
    if tokenizer_path not in _made:
        _made[tokenizer_path] = Encoder(tokenizer_path)
    return _made[tokenizer_path]


def text_groups(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[tuple[list, pa.Array]]:
    """(doc ids, texts) of about ``most`` bytes, so that memory stays bounded."""
    ids: list = []
    held: list[pa.Array] = []
    size = 0
    for b in batches:
        texts, names = b.column("text"), b.column("doc_id").to_pylist()
        n = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at, before = 0, 0
        while at < len(names):
            end = max(at + 1, int(np.searchsorted(n, before + most - size, side="right")))
            ids += names[at:end]
            held.append(texts.slice(at, end - at))
            size += int(n[end - 1]) - before
            before, at = int(n[end - 1]), end
            if size >= 0.9 * most or at < len(names):
                yield ids, pa.concat_arrays(held)
                ids, held, size = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(held)
    held = []
    give_back()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
