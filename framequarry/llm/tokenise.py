"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once a worker.

The vocabulary's pre-tokeniser cuts a text into words that are encoded on their own.  Texts of
Latin letters, whose classes are certain, are cut in numpy over all bytes of a batch, and their
words are coded by dictionaries in Arrow, those of up to eight bytes as numbers; the library's model encodes words that are new.  All
other texts go to the library whole.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers before it begins anew.
REMEMBERED = 400_000
#: Words that the library takes as one text.
JOINED = 512
#: Contractions that the pre-tokeniser keeps apart, by their length.
CONTRACTIONS = {2: ("'s", "'t", "'m", "'d"), 3: ("'re", "'ve", "'ll")}
#: The normaliser and the pre-tokeniser that the short cut stands for.
NORMALISER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space within ASCII that separates words.
BLANKS = " \t\n\x0b\x0c\r"
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
#: Bytes of words that are held as a number.
SHORT = 8
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(SHORT + 1)], np.uint64)
#: The short cut takes characters below this, which have two bytes at most.
_END = 0x250


def _classes() -> bytes:
    """The class of each character below _END."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    return bytes(_BLANK if chr(i) in BLANKS else kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(_END))


def _alphabet(byte_level) -> str:
    """The library's character for each byte of the characters below _END; a blank is kept, and bytes that none of them has are refused."""
    out = ["\ufffe"] * 256
    out[ord(" ")] = " "
    for i in range(0x21, _END):
        ((letters, _),) = byte_level.pre_tokenize_str(chr(i))
        for b, letter in zip(chr(i).encode(), letters, strict=True):
            out[b] = letter
    return "".join(out)


def _numbers(letters: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of 1 to SHORT bytes as numbers, the first byte lowest; they hold no zero byte, so different words have different ones."""
    eights = np.zeros(len(letters) // SHORT + 2, "<u8")
    eights.view(np.uint8)[: len(letters)] = letters
    at, by = begin >> 3, (begin & 7).astype(np.uint64) << np.uint64(3)
    both = eights[at] >> by | eights[at + 1] << (np.uint64(63) - by) << np.uint64(1)
    return both & _MASKS[size]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # The same model, held once, for words that are cut already and written in the alphabet of bytes.
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = _alphabet(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        state = lambda part: json.loads(part.__getstate__()) if part else {}
        vocab = self.whole.get_vocab()
        self.vocab = max(vocab.values()) + 1
        self.last = np.zeros(self.vocab, bool)  # ids that end a word
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")
        steps, cut = state(self.whole.normalizer), state(self.whole.pre_tokenizer).get("pretokenizers", [{}])
        self.short_cut = [x["type"] for x in steps.get("normalizers", [])] == NORMALISER and cut[0].get("pattern", {}).get("Regex") == PATTERN and [x.get("type") for x in cut] == ["Split", "ByteLevel"] and getattr(self.whole.model, "end_of_word_suffix", None) == "</w>"
        known = "".join(re.escape(chr(i)) for i in range(0x21, _END) if not 0x7F <= i <= 0xA0)
        self.plain = re.compile(f"[{known}{BLANKS}]*")
        self.classes = np.frombuffer(_classes(), np.uint8)
        self.of_byte = self.classes[:128].tobytes() + bytes([_LETTER]) * 128
        self.forget()

    def forget(self) -> None:
        """Drop the words learnt so far."""
        # Words of up to SHORT bytes as a number, then longer ones; and their places in the order in which words were learnt.
        self.words = [pa.array([], pa.uint64()), pa.array([], pa.binary())]
        self.places = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)  # of the words' ids, and a zero before

    def _learn(self, held: list[bytes]) -> None:
        joined = [codecs.charmap_decode(b" ".join(held[i : i + JOINED]), "strict", self.alphabet)[0] for i in range(0, len(held), JOINED)]
        flat = np.concatenate([np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)])
        ends = self.last[flat].nonzero()[0] + 1
        if len(ends) != len(held):
            raise ValueError("a word's ids have another end than its last")
        self.ends = np.concatenate((self.ends, len(self.ids) + ends))
        self.ids = np.concatenate((self.ids, flat))

    def _place(self, kind: int, words: pa.Array) -> np.ndarray:
        """The places of words of a kind in the order in which words were learnt; new ones are learnt."""
        coded = pc.dictionary_encode(words)
        own = coded.dictionary
        found = pc.index_in(own, value_set=self.words[kind]).fill_null(-1).to_numpy()
        new = found < 0
        if new.any():
            fresh = own.filter(pa.array(new))
            begin = len(self.ends) - 1
            self._learn(fresh.to_pylist() if kind else fresh.to_numpy().astype("<u8").view(f"S{SHORT}").tolist())
            found = np.where(new, len(self.words[kind]) + np.cumsum(new) - 1, found)
            self.words[kind] = pa.concat_arrays([self.words[kind], fresh])
            self.places[kind] = np.append(self.places[kind], np.arange(begin, begin + len(fresh)))
        return self.places[kind][found].take(coded.indices.to_numpy())

    def _cut(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a text in UTF-8 begin, and the class of each byte; the text ends with a blank."""
        b, kind = np.frombuffer(raw, np.uint8), np.frombuffer(bytearray(raw.translate(self.of_byte)), np.uint8)
        lead = (b >= 0xC0).nonzero()[0]
        if len(lead):
            of = self.classes[(b[lead] & 0x1F).astype(np.int32) << 6 | b[lead + 1] & 0x3F]
            kind[lead] = kind[lead + 1] = of
        begins = np.empty(len(b), bool)
        begins[0] = kind[0] != _BLANK
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins &= kind != _BLANK
        number = (kind == _NUMBER).nonzero()[0]
        begins[number[(b[number] & 0xC0) != 0x80]] = True  # each alone
        mark = (b == ord("'")).nonzero()[0]
        mark = mark[(mark == 0) | (kind[mark - 1] != _OTHER)]
        for n, endings in CONTRACTIONS.items():
            for e in endings:
                at = mark[mark + n < len(b)]
                at = at[(b[at + 1] == ord(e[1])) & (b[at + n - 1] == ord(e[-1]))]
                begins[at + 1] = False
                begins[at + n] |= kind[at + n] == _LETTER
        return begins.nonzero()[0], kind

    def _short(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts in lower case."""
        raw = "\n".join([*texts, ""]).encode()
        at, kind = self._cut(raw)
        solid = kind != _BLANK
        gaps = np.cumsum(~solid, dtype=np.int32)
        letters = np.frombuffer(raw, np.uint8)[solid]
        offsets = np.append(at - gaps[at], len(letters)).astype(np.int32)
        if len(self.ends) > REMEMBERED:
            self.forget()
        begin, size = offsets[:-1], np.diff(offsets)
        word = np.empty(len(at), np.int64)
        i = (size <= SHORT).nonzero()[0]
        word[i] = self._place(0, pa.array(_numbers(letters, begin[i], size[i])))
        i = (size > SHORT).nonzero()[0]
        word[i] = self._place(1, pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).take(pa.array(i)))
        begin = self.ends[:-1].take(word)
        size = np.diff(self.ends).take(word)
        ends = np.cumsum(size)
        flat = self.ids.take(np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size))
        # A text's words begin before its end.
        sizes = np.cumsum([len(t.encode()) + 1 if not t.isascii() else len(t) + 1 for t in texts])
        upto = np.append(0, ends)[np.append(0, np.searchsorted(at, sizes))]
        return [flat[s:e] for s, e in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them for the whole text without special tokens."""
        out: list = [None] * len(texts)
        cut: dict[int, str] = {}
        for i, t in enumerate(texts):
            # The special tokens' strings are found in the raw text; any other mark of theirs is left to the library.
            if self.short_cut and "<|" not in t and self.plain.fullmatch(t) and unicodedata.is_normalized("NFC", t):
                low = t.lower()
                if len(low) == len(t) and (low.isascii() or self.plain.fullmatch(low)):
                    cut[i] = low
        if cut:
            for i, ids in zip(cut, self._short(list(cut.values())), strict=True):
                out[i] = ids
        rest = [i for i in range(len(texts)) if i not in cut]
        for i, e in zip(rest, self.whole.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = np.array(e.ids, np.int32)
        return out
