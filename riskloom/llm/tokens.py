"""Exact token ids inside Spark tasks, with a memory of words.

For the two layouts below the library splits a text at blanks before anything else, so the ids
of a text are those of its words in order. A task keeps the ids of words it has met; only new
words go to the library: those of printable ASCII and Latin letters cut into the layout's own
pre-tokens, for which only the merges are left to do, others as they are. Whatever does not fit
the layout (other tokenizers, special strings, odd white space) goes to the library as a whole
text, so results are always the library's own.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import weakref
from functools import lru_cache

WORDS_KEPT = 700_000  # words that a task remembers; those not met among the last half of them are forgotten

_LATIN = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"  # letters that lower-casing and composing leave alone
_LATIN_ANY = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_SIMPLE = rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]){1,100}"  # printable ASCII and Latin letters; long ones would fill the memory with their parts
_RUNS = {  # the layouts' patterns, as they cut a word of these
    "dropped": r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+",
    "leading": r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ A-Za-zÀ-ÖØ-öø-ÿ0-9]+",
}
_MARK, _BARE = b"\x01", b"\x02"  # stand before a mark, and before a word that no blank precedes


def _class_table() -> bytes:
    """Classes of bytes: a letter (of ASCII or the second byte of a Latin one), a closing mark, other, far."""
    table = bytearray(b"#" * 128 + b"!" * 128)
    for c in range(256):
        if bytes([c]).isalpha() or 0x9F <= c <= 0xBF and c != 0xB7 or c == 0xC3:
            table[c] = ord("a")
        elif 0x80 <= c < 0xC0:
            table[c] = ord("#")
    table[ord(",")] = table[ord(".")] = ord(",")
    return bytes(table)


_CLASSES = _class_table()


def marks_apart(raw: bytes) -> bool:
    """Every ``,`` and ``.`` follows a letter, so none is part of a longer run of marks."""
    classes = raw.translate(_CLASSES)
    return not (b"#," in classes or b",," in classes or b"!" in classes or classes[:1] == b",")


_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _byte_chars() -> dict[int, str]:
    """The character that byte-level vocabularies use for each byte: itself if it can be printed."""
    plain = [b for b in range(256) if unicodedata.category(chr(b))[0] not in "CZ"]
    table = {b: chr(b) for b in plain}
    table |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}
    return table


def split_id(tokenizer_json: dict) -> str | None:
    """Which of the two layouts the tokenizer has: "dropped" blanks, "leading" blanks, or neither."""
    pre, norm = tokenizer_json.get("pre_tokenizer") or {}, tokenizer_json.get("normalizer")
    if tokenizer_json.get("truncation") or tokenizer_json.get("padding"):
        return None
    if any(t.get(k) for t in tokenizer_json.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    if tokenizer_json.get("model", {}).get("type") != "BPE" or tokenizer_json["model"].get("dropout"):
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "leading"
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if kinds == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in parts] == ["Split", "ByteLevel"]:
        first, second = parts
        pattern = first.get("pattern", {}).get("Regex", "")
        # fixed value: the word pattern of this layout
        if pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and first.get("invert") and first.get("behavior") == "Removed":
            if not second.get("use_regex", True) and not second.get("add_prefix_space"):
                return "dropped"
    return None


class _Apart(Exception):
    """The words of a text can't be encoded one by one."""


class _Words(dict):
    """Ids per word; a word that is missing comes from the words before these or is encoded."""

    def __init__(self, encoder: Encoder, kept: int):
        # a weak one: an encoder that is dropped goes at once, and its words with it
        self.encoder, self.kept, self.older = weakref.proxy(encoder), kept, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoder.new(word)
        if len(self) >= self.kept // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """``ids(raw)`` gives the ids of a UTF-8 text as little-endian 32-bit numbers."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT, memory: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.layout = split_id(config) if memory else None
        self.special = tuple({t["content"].lower().encode()[:2] for t in config.get("added_tokens", []) if t["content"]})
        self.known = _Words(self, words_kept)
        self.chars, self.model = _byte_chars(), self.library.model
        self.plain, self.simple = re.compile(_LATIN if self.layout == "dropped" else _LATIN_ANY), re.compile(_SIMPLE)
        self.runs = re.compile(_RUNS.get(self.layout, ""))
        self.packed = [struct.pack("<I", i) for i in range(1 + max(self.library.get_vocab().values(), default=0))]
        self.ends = {m: self.whole(m) for m in (b",", b".")}

    def whole(self, raw: bytes) -> bytes:
        ids = self.library.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, word: bytes) -> bytes:
        """Ids of one pre-token: only the merges are left to do."""
        chars = word.decode() if word.isalpha() else "".join(map(self.chars.__getitem__, word))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(chars)])

    def _tail(self, word: bytes) -> bool:
        """The word is letters and one closing mark, which are always tokens of their own."""
        return len(word) > 1 and word[-1:] in (b",", b".") and word[-2] in _LETTERS

    def new(self, word: bytes) -> bytes:
        return self._dropped(word) if self.layout == "dropped" else self._leading(word)

    def _dropped(self, word: bytes) -> bytes:
        if self.plain.fullmatch(word):
            return self._run(word)
        if self._tail(word):
            return self.known[word[:-1]] + self.ends[word[-1:]]
        if self.simple.fullmatch(word):
            runs = [r.encode() for r in self.runs.findall(word.decode().lower())]
            return self._run(runs[0]) if len(runs) == 1 else b"".join(map(self.known.__getitem__, runs))
        return self.whole(word)

    def _leading(self, word: bytes) -> bytes:
        """``word`` and the blank before it. Where blanks touch, the rule does not hold."""
        if word[:1] == _MARK:
            return self.whole(word[1:])
        if self._tail(word):
            return self.known[word[:-1]] + self.ends[word[-1:]]
        bare = word[:1] == _BARE
        body = word[1:] if bare else word
        if self.plain.fullmatch(body):
            return self._run(body if bare else b" " + body)
        if self.simple.fullmatch(body):
            runs = [r.encode() for r in self.runs.findall(body.decode() if bare else " " + body.decode())]
            if len(runs) == 1:
                return self._run(runs[0])
            return b"".join(self.known[r[1:] if r[:1] == b" " else _BARE + r] for r in runs)
        text = body.decode("utf-8", "replace")
        if not text or text[0].isspace() or text[-1].isspace():
            raise _Apart
        return self.whole(body if bare else b" " + body)

    def _looked_up(self, words: list[bytes]) -> bytes | None:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except _Apart:
            return None

    def ids(self, raw: bytes) -> bytes:
        if not raw:
            return b""
        ids, lowered = None, raw.lower()
        if self.layout is None or any(s in lowered for s in self.special):
            return self.whole(raw)
        apart = marks_apart(raw)
        if self.layout == "dropped":
            if apart:  # closing marks become words of their own
                lowered = (lowered + b" ").replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" . ")
            ids = self._looked_up(lowered.split())
        elif _MARK not in raw and _BARE not in raw:
            marked = _BARE + raw
            if apart:
                marked = marked.replace(b", ", b" \x01, ").replace(b". ", b" \x01. ").replace(b".\n", b" \x01.\n")
            marked = marked.replace(b"\n", b" \x01\n \x02")
            ids = self._looked_up(marked.split(b" "))
        return self.whole(raw) if ids is None else ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept for its later tasks."""
    return Encoder(path)


def named_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


