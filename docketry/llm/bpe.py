"""Token ids of whole texts for public byte-pair tokenizers, faster than one call of the tokenizer for each text.

The tokenizer file is the law: ``Bpe.encode`` gives what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives.
Two layouts are merged by a compiled encoder over the same vocabulary; any other file, and any text that the fast way
does not cover, goes to the tokenizer itself:

* byte layout: the ranks of byte strings, cut by the file's own pattern;
* word layout (lower case, white space dropped, a mark at the end of words): words are closed with a zero byte, which
  stands for the mark and always merges first.

Texts that hold an added token (such as ``<|endoftext|>``) always go to the tokenizer, which knows them as one id.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

MARK = "</w>"
#: The splitting patterns of the two public layouts.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this character every version of Unicode that the libraries use agrees on what is a letter.
KNOWN = 0x052F
OTHER = re.compile(f"[^\0-{chr(KNOWN)}]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _known_words() -> re.Pattern:
    """WORD_PATTERN over the known characters, lower-cased, with their letters and numbers written out."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(KNOWN + 1)):
        kinds.get(unicodedata.category(c)[0], []).append(re.escape(c))
    letters, numbers, blanks = "".join(kinds["L"]), "".join(kinds["N"]), "\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+")


class Bpe:
    """Ids of one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec["added_tokens"]]
        model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
        known = model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("continuing_subword_prefix") and not spec.get("post_processor")
        self.layout = None
        if known and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space") and not spec.get("normalizer") and not model.get("end_of_word_suffix"):
            self.layout = "byte"
        elif known and model.get("end_of_word_suffix") == MARK and self._is_word_layout(spec):
            self.layout = "word"
        if self.layout:
            self._load(model)

    @staticmethod
    def _is_word_layout(spec: dict) -> bool:
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": WORD_PATTERN} and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed"

    def _load(self, model: dict) -> None:
        import regex
        import tiktoken

        alphabet, vocab, word = byte_alphabet(), model["vocab"], self.layout == "word"

        def raw(token: str) -> bytes:
            end = word and token.endswith(MARK)
            return bytes(alphabet[c] for c in (token[: -len(MARK)] if end else token)) + (b"\0" if end else b"")

        # a rank for each byte string, and the id of each rank; last bytes of words merge with the mark before all else
        singles = [(c, b) for c, b in alphabet.items()]
        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        if word:
            for c, b in singles:
                ranks[bytes([b, 0])] = len(ids)
                ids.append(vocab[c + MARK])
        for c, b in singles:
            ranks[bytes([b])] = len(ids)
            ids.append(vocab[c])
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            token = left + right
            if raw(token) in ranks:  # two ways to one token: ranks of byte strings could not tell them apart
                self.layout = None
                return
            ranks[raw(token)] = len(ids)
            ids.append(vocab[token])
        self.ids = np.array(ids, np.uint32)
        pattern = r"[^\x00]+\x00" if word else BYTE_PATTERN
        self.encoder = tiktoken.Encoding(self.layout, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words, self.known_words = regex.compile(WORD_PATTERN), _known_words()

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, text: str) -> list[str] | None:
        """Lower-case words of a text of known characters, else None."""
        if text.isascii():
            return self.known_words.findall(text.lower())
        if OTHER.search(text):
            return None
        if "\u03a3" in text:  # its lower case depends on the place in the word for one library, not for the other
            low = self.tokenizer.normalizer.normalize_str(text)
        else:
            low = unicodedata.normalize("NFC", text).lower()
        return (self.words if OTHER.search(low) else self.known_words).findall(low)

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.layout is None or any(a in text for a in self.added):
            return self._exact(text)
        if self.layout == "word":
            if "\0" in text:
                return self._exact(text)
            words = self._words(text)
            if words is None:
                return self._exact(text)
            if not words:
                return np.zeros(0, np.uint32)
            text = "\0".join(words) + "\0"
        return self.ids[np.array(self.encoder.encode_ordinary(text), np.int64)]


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tokenizer of a file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
