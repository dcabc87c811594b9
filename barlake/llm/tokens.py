"""Token ids of whole texts with the tokenizers library, each distinct stretch of text encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from array import array

from .textops import let_go, new_store

#: Stretches kept by one worker, some 150 bytes each. A full store stays as it is, for what is frequent comes early,
#: and is renewed after ten times as many stretches had no place in it.
KEPT = 600_000
_loaded: dict[str, Encoder] = new_store()
#: Latin letters, of which the pattern makes one token, and up to three marks (no apostrophe), which make another.
_WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]{0,3})")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Spacing(Exception):
    """A stretch that is empty or begins or ends with white space."""


class _Stretches(dict):
    """Ids of stretches that follow a space, or with an empty `lead` a line break, made when first asked for."""

    def __init__(self, tokenizer, lead: str = " ", kept: int = KEPT):
        self.split, self.model = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        self.lead, self.kept, self.unkept = lead, kept, 0
        self.lead_piece = self.split(" a")[0][0][0] if lead else ""  # the character of the byte-level alphabet that stands for a space
        self.letters = {ord(c): self.split(c)[0][0] for c in map(chr, range(0xC0, 0x250)) if c.isalpha()}
        self.line = self.ids(self.split("\n")[0][0])
        self.marks = {"": b""}
        self.after_line = _Stretches(tokenizer, "", kept // 6) if lead else self

    def ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model(piece)]).tobytes()

    def __missing__(self, text: str) -> bytes:
        if not text or text[0].isspace() or text[-1].isspace():
            raise _Spacing
        if "\n" in text:
            first, *rest = text.split("\n")
            if first and not first[-1].isspace() and not any(not x or x[0].isspace() or x[-1].isspace() for x in rest):
                # a line break between two characters that are no white space is a token, whatever they are; mostly
                # such stretches are new and the words in them are not, so only these are kept
                return self[first] + b"".join([self.line + self.after_line[x] for x in rest])
        word = _WORD.fullmatch(text)
        if not word:
            found = b"".join([self.ids(p) for p, _ in self.split(self.lead + text)])
        elif word[2]:
            # letters, then marks: two tokens' worth of text, whatever comes next; kept once the word is known without them
            known = self.get(word[1])
            found = (known or self[word[1]]) + (self.marks.get(word[2]) or self.marks.setdefault(word[2], self.ids(word[2])))
            if not known:
                return found
        else:
            found = self.ids(self.lead_piece + (text if text.isascii() else text.translate(self.letters)))
        if len(self) < self.kept:
            self[text] = found
        else:
            self.unkept += 1
            if self.unkept > 10 * self.kept:
                self.clear()
                self.unkept = 0
        return found


def _cuts_at_spaces(path: str) -> bool:
    """Whether a vocabulary file is a byte-level BPE whose own pattern splits texts: no normalizer, no prefix space."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    split, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    plain = not parts.get("normalizer") and not parts.get("truncation") and not parts.get("padding")
    own = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    return plain and own and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")


class Encoder:
    """Ids of a vocabulary file as little-endian uint32 bytes, as the library gives them for whole texts.

    For a byte-level BPE with that pre-tokenizer's own pattern a text is cut before every single space that stands
    between two characters that are not white space. The pattern always ends a token there (a space is taken only as
    the first character of a token, and no token holds a space between two others), and so it does on both sides of a
    single line break; encoding the stretches one by one gives the ids of the whole, and they are kept with their ids. A text with other spacing, one that holds the
    name of an added token (which the library reads as that token), and every text of another kind of vocabulary is
    encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.stretches = _Stretches(self.whole) if _cuts_at_spaces(path) else None

    def encode(self, text: str) -> bytes:
        if self.stretches is None or any(t in text for t in self.added):
            return self._whole(text)
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            try:
                return self._whole(first) + b"".join(map(self.stretches.__getitem__, rest))
            except _Spacing:
                pass
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


def encoder(path: str) -> Encoder:
    let_go(but=_loaded)
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
