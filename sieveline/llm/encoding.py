"""Token ids of texts, by a public vocabulary of the ``tokenizers`` library.

A vocabulary that lower-cases, splits by a plain pattern and drops white space
encodes each piece of a word by itself.  So texts are cut into pieces by array
operations; the distinct ones of a few megabytes are encoded by the library's own
model and kept in a bounded memo of the Python worker.  Texts with characters for
which that doesn't hold plainly (beyond Latin letters, control characters, special
tokens) go through the library whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np

from sieveline.llm.rolling import mix

#: Tabs, line ends, and characters that stand alone in NFC and whose lower case stays among them.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
# Fixed value: the pattern that such a vocabulary splits by.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KEEP, _LONG_WORD, _PART = 500_000, 64, 4 << 20
_GAP = re.compile(rb"[\t\n\r ]")
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


_PIECES = re.compile(_SPLIT.replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N")))
# kinds of bytes, and of two-byte characters by their second byte
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _kind(c: str) -> int:
    return _SPACE if c in "\t\n\r " else {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(c)[0], _OTHER)


_KINDS = np.array([_kind(chr(c)) if c < 128 else _LETTER for c in range(256)], np.uint8)
_SECOND = {lead: np.array([_kind(chr((lead & 31) << 6 | c & 63)) for c in range(256)], np.uint8) for lead in (0xC2, 0xC3)}
# byte-level letters: printable bytes stand for themselves, the others for code points from 256 on
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip([*_SHOWN, *(b for b in range(256) if b not in _SHOWN)], map(chr, [*_SHOWN, *range(256, 256 + 256 - len(_SHOWN))])))


class _Memo(dict):
    """What ``make`` gives for each key; of two generations of keys the older is dropped when the younger is full."""

    def __init__(self, make, most: int = _KEEP, longest: int = _LONG_WORD):
        self.make, self.most, self.longest, self.old = make, most // 2, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        steps = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers") or []]
        self.by_word = first.get("pattern", {}).get("Regex") == _SPLIT and first.get("invert") is True and steps == ["NFC", "Replace", "Lowercase"]
        self.pieces = _Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        out = []
        # an apostrophe comes with the letters after it
        for part in _PIECES.findall(piece) if piece[0] == "'" else (piece,):
            letters = part if part.isascii() else "".join(_BYTES[b] for b in part.encode())
            out += [t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(letters)]
        return b"".join(out)

    def _chunk(self, raw: bytes, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the pieces in ``raw[at:to]``: where they start, which distinct piece each is, the number of ids of each distinct piece, and these ids."""
        n = to - at
        data = np.zeros(n + 24, np.uint8)
        data[:n] = np.frombuffer(raw, np.uint8, n, at)
        kinds = np.zeros(n + 1, np.uint8)
        kinds[:n] = _KINDS[data[:n]]
        for lead, table in _SECOND.items():
            p = np.flatnonzero(data[:n] == lead)
            kinds[p] = kinds[p + 1] = table[data[p + 1]]
        edge = np.ones(n + 1, bool)
        np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
        edge[:n] |= (kinds[:n] == _DIGIT) & ((data[:n] & 0xC0) != 0x80)  # each digit is a piece
        quote = np.flatnonzero(data[:n] == 0x27)
        quote = quote[edge[quote] & (kinds[quote + 1] == _LETTER)]
        edge[quote + 1] = False
        edges = np.flatnonzero(edge)
        some = kinds[edges[:-1]] != _SPACE
        starts, ends = edges[:-1][some], edges[1:][some]
        lengths = ends - starts
        # the eight bytes at each place; of a short piece they are the piece itself
        eight = np.ndarray((n + 16,), "<u8", data.data, strides=(1,))
        mark = eight[starts] & _MASK[np.minimum(lengths, 8)]
        long = np.flatnonzero(lengths > 8)
        more = [eight[starts[long] + 8 * k] & _MASK[np.clip(lengths[long] - 8 * k, 0, 8)] for k in (1, 2)]
        first8 = mark[long]
        mark[long] = mix(mix(mix(first8, 41) ^ more[0], 42) ^ more[1], 43)
        for i in np.flatnonzero(lengths > 24).tolist():
            mark[i] = int.from_bytes(hashlib.blake2b(raw[at + starts[i] : at + ends[i]], digest_size=8).digest(), "little")
        order = np.argsort(mark)
        fresh = np.ones(len(order), bool)
        fresh[1:] = mark[order[1:]] != mark[order[:-1]]
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        distinct = [self.pieces[raw[a:b].decode()] for a, b in zip((at + starts[first]).tolist(), (at + ends[first]).tolist())]
        counts = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        return at + starts, kind, counts, np.frombuffer(b"".join(distinct), "<u4")

    def flat(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, without special tokens, and the number of ids of each (alone without ``ids``)."""
        plain = np.array([self.by_word and _PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts], bool)
        sizes = np.zeros(len(texts), np.int64)
        others = np.flatnonzero(~plain).tolist()
        found = dict(zip(others, self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False) if others else ()))
        for i, e in found.items():
            sizes[i] = len(e.ids)
        bodies = [texts[i].lower().encode() for i in np.flatnonzero(plain).tolist()]
        raw = b"\n".join(bodies)
        bounds = np.concatenate(([0], np.cumsum([len(b) + 1 for b in bodies], dtype=np.int64)))
        del bodies
        parts, own, at = [], np.zeros(int(plain.sum()), np.int64), 0
        while at < len(raw):  # parts that end at white space
            gap = _GAP.search(raw, at + _PART)
            to = gap.start() if gap else len(raw)
            starts, kind, counts, values = self._chunk(raw, at, to)
            each = counts[kind]
            sums = np.concatenate(([0], np.cumsum(each)))
            own += np.diff(sums[np.searchsorted(starts, bounds)])
            if ids:
                place = np.repeat((np.cumsum(counts) - counts)[kind] - sums[:-1], each)
                place += np.arange(len(place))
                parts.append(values[place])
            at = to
        sizes[plain] = own
        out = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        if found and ids:
            pieces, ends = [], np.cumsum(own)
            for i, k in enumerate(np.cumsum(plain) - 1):
                pieces.append(np.array(found[i].ids, "<u4") if i in found else out[ends[k] - own[k] : ends[k]])
            out = np.concatenate(pieces)
        return out, sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit values, without special tokens."""
        values, sizes = self.flat(texts)
        body = values.tobytes()
        ends = np.cumsum(4 * sizes).tolist()
        return [body[a:b] for a, b in zip([0, *ends], ends)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for the vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def batches(texts: list, size: int = 4 << 20):
    """Ranges of ``texts`` of about ``size`` characters; nulls count as empty."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield start, [t or "" for t in texts[start : i + 1]]
            start, total = i + 1, 0
    if start < len(texts):
        yield start, [t or "" for t in texts[start:]]
