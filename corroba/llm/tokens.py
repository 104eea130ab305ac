"""Encoding texts with a public tokenizer through a worker's cache of space-separated parts.

Both public vocabularies split text at white space before they merge, so a part that
starts after one space and neither starts nor ends with white space has the same ids in
every text. A text is cut at such spaces; each part is looked up, and only parts that
the worker has not met go to the tokenizers library. Parts of ASCII and Latin-1 letters
are cut into the library's words here, each of which its model encodes once; all others
go through the whole tokenizer, many in one call. Parts beside other white space are cut
more carefully and are not kept.
"""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts that a worker keeps of the latest texts; as many older ones are kept beside them.
CACHE_ENTRIES = 350_000
#: Longer parts are encoded each time.
CACHED_CHARS = 48
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters that every Unicode version classes alike and that normal forms leave alone.
_PLAIN = re.compile(f" ?[!-~{_LETTER}](?:[!-~\\n{_LETTER}]*[!-~{_LETTER}])?")
#: How the two public vocabularies split text, for plain parts. Fixed values.
_SPLIT = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+"),
}
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[tuple[str, str], "PartCache"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Parts(dict):
    """Values of parts; a part that is not there is looked for or encoded by the owner."""

    def __init__(self, owner: PartCache, given: dict):
        super().__init__(given)
        self.owner = owner

    def __missing__(self, key: str):
        return self.owner.meet(key)


class PartCache:
    """Part -> number of ids ("lengths") or ids as little-endian 16-bit bytes ("ids").

    A key that starts with a space is the first part of a text, which no space precedes.
    """

    def __init__(self, path: str, kind: str, given: dict | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.kind, self.given = kind, given or {}
        self.cache, self.older, self.odd = _Parts(self, self.given), {}, False
        style = _style(self.tokenizer)
        self.split, self.words, self.lower = _SPLIT.get(style), {}, style == "word"
        self.as_bytes, self.joined = _byte_letters(), sum if kind == "lengths" else b"".join

    def give(self, entries: dict) -> None:
        """Entries that stay, whatever else is kept."""
        if entries is not self.given:
            self.given = entries
            self.cache.update(entries)

    def _turn(self) -> None:
        if len(self.cache) > CACHE_ENTRIES + len(self.given):
            self.older, self.cache = self.cache, _Parts(self, self.given)
        if len(self.words) > CACHE_ENTRIES // 4:
            self.words.clear()

    def _encode(self, keys: list[str]) -> list:
        texts = [k[1:] if k[:1] == " " else f" {k}" for k in keys]
        return [self._value(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _value(self, ids: list[int]):
        return len(ids) if self.kind == "lengths" else array("H", ids).tobytes()

    def meet(self, key: str):
        """The value of a part that is not among the latest; None, and a note of it, if it is not plain."""
        value = dict.get(self.older, key)
        if value is None:
            if not self.split or len(key) > CACHED_CHARS or not _PLAIN.fullmatch(key) or "<|" in key:
                self.odd = True
                return None
            text = key[1:] if key[0] == " " else f" {key}"
            found = self.split.findall(text.lower() if self.lower else text)
            value = self._word(found[0]) if len(found) == 1 else self.joined(map(self._met_word, found))
        self.cache[key] = value
        return value

    def _word(self, word: str):
        return self._value([t.id for t in self.tokenizer.model.tokenize(word.translate(self.as_bytes))])

    def _met_word(self, word: str):
        """The value of a word beside others; it may be known as a part."""
        value = self.words.get(word)
        if value is None:
            if self.lower or word[0] == " ":
                value = dict.get(self.cache, word.lstrip(" ")) or dict.get(self.older, word.lstrip(" "))
            if value is None:
                value = self.words[word] = self._word(word)
        return value

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its parts, in order."""
        out, again = [], []
        for i, text in enumerate(texts):
            self._turn()
            self.odd = False
            parts = (_lower(text) if self.lower else text).split(" ")
            parts[0] = f" {parts[0]}"
            out.append(list(map(self.cache.__getitem__, parts)))
            if self.odd:
                again.append((i, parts))
        if not again:
            return out
        # parts that are not plain: the whole tokenizer, many at once
        get = self.cache.get
        for k, (i, parts) in enumerate(again):
            if len(parts) > 1 and any(x is None and _uneven(w) for w, x in zip(parts, out[i])):
                parts = _SAFE_SPACE.split(texts[i])
                parts[0] = f" {parts[0]}"
                again[k] = i, parts
        rest = list({w for _, parts in again for w in parts if w not in self.cache})
        encoded = dict(zip(rest, self._encode(rest)))
        for i, parts in again:
            out[i] = [encoded[w] if x is None else x for w, x in zip(parts, map(get, parts))]
        self.cache.update({w: x for w, x in encoded.items() if len(w) <= CACHED_CHARS and not _uneven(w)})
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        return [b"".join(v) for v in self.values(texts)]

    def lengths(self, texts: list[str]) -> list[int]:
        return [sum(v) for v in self.values(texts)]


def _style(tokenizer) -> str:
    """Which of the two known ways of splitting the tokenizer has, or none."""
    made = json.loads(tokenizer.to_str())
    before, split = made["normalizer"], made["pre_tokenizer"]
    if before is None and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return "byte"
    steps = [n["type"] for n in (before or {}).get("normalizers", [])]
    patterns = [p.get("pattern", {}).get("Regex") for p in (split or {}).get("pretokenizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and patterns == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", None]:
        return "word"
    return ""


def _byte_letters() -> dict[int, str]:
    """For each plain character the letters by which byte-level vocabularies write its bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


def _lower(text: str) -> str:
    """The text as the tokenizer itself would lower it, where that is plain; more of it is then known."""
    if "<|" in text:  # special strings are found before lowering
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _uneven(key: str) -> bool:
    """Whether what stands beside the key could change its ids."""
    if key[:1] == " ":
        return len(key) < 2 or key[-1].isspace()
    return not key or key[0].isspace() or key[-1].isspace()


def part_cache(path: str, kind: str) -> PartCache:
    """The cache of this worker process; it lives as long as the process."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = PartCache(path, kind)
    return _loaded[path, kind]
