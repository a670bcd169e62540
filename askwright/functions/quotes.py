"""Quotes in a source text, found word by word.

Text and quote are cut into tokens: a run of letters and digits, or a single other sign.  Tokens compare without case, width or
typography; asterisks and backticks are no tokens; white space counts only between tokens that typography does not set apart.
A quote stands where its tokens follow each other in the text, so it never begins or ends within a word.  Most characters have one
character as their form, which is a letter where they are one: a text of those alone is cut as a whole, by arrays.  In other texts
the tokens of a chunk between white space depend on it alone, so those of common chunks are kept.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwright.functions.unicode_text import LIST_MARKER, NO_SPACE_AFTER, NO_SPACE_BEFORE, QUOTES

CHUNK, TOKEN = re.compile(r"\S+"), re.compile(r"(?:[^\W_][\u0300-\u036f]*)+|\S")
MARKS = "*`"
TYPE = str.maketrans(QUOTES)
CLOSING = frozenset(" .;:,!")
SHORTEST = 3  # characters of a quote's tokens that are looked for
CUT = 1 << 20  # characters of texts that are cut together, unless one text is longer
APART, JOINED = " ", "\0"  # what stands before a token: white space that counts, or not


@lru_cache(1 << 17)
def _pieces(chunk: str) -> tuple[tuple[str, int, int], ...]:
    """(form, start, stop) of the tokens of a chunk without white space."""
    if chunk.isalnum() and chunk.isascii():
        return ((chunk.lower(), 0, len(chunk)),)
    out: list[tuple[str, int, int]] = []
    for m in TOKEN.finditer(chunk):
        if m[0] in MARKS:
            continue
        form = "".join(unicodedata.normalize("NFKC", c) for c in m[0].translate(TYPE)).casefold()  # accents stay as written
        if m[0][0].isalnum() and out and out[-1][0][-1].isalnum():  # a word that marks of emphasis divide
            out[-1] = (out[-1][0] + form, out[-1][1], m.end())
        else:
            out += [(f, m.start(), m.end()) for f in ([form] if m[0][0].isalnum() else form) if not f.isspace()]
    return tuple(out)


def tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    """Each token's form behind APART or JOINED, where it starts and where it stops."""
    forms, starts, stops = [], [], []
    last = "("  # before the first token, nothing counts
    for m in CHUNK.finditer(text):
        at, before = m.start(), APART
        for form, a, b in _pieces(m[0]):
            forms.append((JOINED if before is JOINED or last in NO_SPACE_AFTER or form[0] in NO_SPACE_BEFORE else APART) + form)
            starts.append(at + a)
            stops.append(at + b)
            last, before = form[-1], JOINED
    return forms, starts, stops


@lru_cache(1)
def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point of the first plane: the form; 0 white space, 1 letter or digit, 2 sign, 3 none that arrays cut; and of forms,
    whether white space counts after or before them."""
    forms, kinds = np.arange(1 << 16, dtype=np.uint32), np.full(1 << 16, 3, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        form = "".join(unicodedata.normalize("NFKC", x) for x in c.translate(TYPE)).casefold()
        if c.isspace():
            kinds[code] = 0
        elif len(form) == 1 and ord(form) < 1 << 16 and form.isalnum() == c.isalnum() and not (form.isspace() or c in MARKS or 0x300 <= code <= 0x36F or 0xD800 <= code <= 0xDFFF):
            forms[code], kinds[code] = ord(form), 1 if c.isalnum() else 2
    after, before = np.ones(1 << 16, bool), np.ones(1 << 16, bool)
    after[[ord(c) for c in NO_SPACE_AFTER]] = before[[ord(c) for c in NO_SPACE_BEFORE]] = False
    return forms, kinds, after, before


def _cut(text: str) -> tuple[str, list[int], list[int], list[int]] | None:
    """What tokens() gives, the forms in one string, and where each of them begins there; None for a text that holds other characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    forms, kinds, after, before = _table()
    if len(codes) == 0 or codes.max() >= len(kinds):
        return None if len(codes) else ("", [0], [], [])
    kind = kinds[codes]
    if kind.max() == 3:
        return None
    at = np.flatnonzero(kind)
    if len(at) == 0:
        return "", [0], [], []
    form, word = forms[codes[at]], kind[at] == 1
    apart, counts, first = np.zeros(len(at), bool), np.zeros(len(at), bool), np.ones(len(at), bool)
    np.greater(at[1:] - at[:-1], 1, out=apart[1:])  # behind white space
    counts[1:] = apart[1:] & after[form[:-1]] & before[form[1:]]
    first[1:] = ~(word[1:] & word[:-1]) | apart[1:]
    begin = np.flatnonzero(first)
    place = np.arange(len(at)) + np.cumsum(first)
    body = np.empty(len(at) + len(begin), np.uint32)
    body[place] = form
    body[place[begin] - 1] = np.where(counts[begin], ord(APART), ord(JOINED))
    last = np.append(begin[1:], len(at)) - 1
    return body.tobytes().decode("utf-32-le"), [*(place[begin] - 1).tolist(), len(body)], at[begin].tolist(), (at[last] + 1).tolist()


def _bare(quote: str) -> str:
    """A quote without its list marker, which is not looked for."""
    return re.sub(LIST_MARKER, "", quote.strip(), count=1)


def _open(body: str) -> str:
    """The tokens of a quote without closing punctuation and what stands before the first."""
    while body and body[-1] in CLOSING:
        body = body[:-2]
    return body[1:]


def needle_of(quote: str) -> str:
    """The forms of a quote's tokens, as tokens() writes them, without closing punctuation and what stands before the first."""
    cut = _cut(quote)
    return _open(cut[0] if cut else "".join(tokens(quote)[0]))


@lru_cache(1)
def _odd() -> re.Pattern:
    """A character that arrays do not cut."""
    runs = np.flatnonzero(np.diff(np.r_[0, _table()[1] == 3, 0])).reshape(-1, 2).tolist()
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in runs) + "\U00010000-\U0010ffff]")


def _bodies(texts: list[str]) -> list[str]:
    """The forms of each text's tokens in one string, cut together; what stands before a text's first token is left open."""
    out, plain, held = [""] * len(texts), [], 0
    for i, text in enumerate(texts):
        if _odd().search(text):
            out[i] = "".join(tokens(text)[0])
            continue
        plain.append(i)
        held += len(text) + 1
        if held >= CUT:
            _cut_into(out, texts, plain)
            plain, held = [], 0
    _cut_into(out, texts, plain)
    return out


def _cut_into(out: list[str], texts: list[str], places: list[int]) -> None:
    body, offsets, starts, _ = _cut("\n".join(texts[i] for i in places))
    begin = 0
    for i, end in zip(places, accumulate(len(texts[i]) + 1 for i in places)):
        stop = offsets[bisect_left(starts, end)]
        out[i], begin = body[begin:stop], stop


def needles(quotes: list[str | None]) -> list[str]:
    """What find() looks for of each quote, cut together: what stands before a quote's first token is not looked for."""
    return [_open(body) for body in _bodies([_bare(q) if q else "" for q in quotes])]


class Source:
    """A text that quotes are looked for in: its tokens in one string, and where each of them begins there."""

    def __init__(self, text: str):
        self.text = text
        if cut := _cut(text):
            body, self.offsets, self.starts, self.stops = cut
        else:
            forms, self.starts, self.stops = tokens(text)
            body, self.offsets = "".join(forms), list(accumulate(map(len, forms), initial=0))
        self.body = body + JOINED

    def find(self, quote: str, after: int = 0, needle: str | None = None) -> tuple[int, int] | None:
        """Span of a quote, the first that begins at `after` or later, else the first of all.  A list marker and closing
        punctuation of the quote are not looked for; a mark of emphasis that closes one within the span, and the quote's own
        . ! ?, are taken in where the text has them.  needle: of needles(), where it was made before."""
        needle = needle_of(_bare(quote)) if needle is None else needle
        if len(needle.replace(JOINED, "")) < SHORTEST:
            return None
        late = self._search(needle, bisect_left(self.starts, after))
        return late and (late[0], self._closed(*late, quote.rstrip()[-1])) or (self.find(quote, 0, needle) if after > 0 else None)

    def _search(self, needle: str, token: int) -> tuple[int, int] | None:
        at = self.body.find(needle, self.offsets[token])
        while at >= 0:
            end = at + len(needle)
            if at and self.body[at - 1] in (APART, JOINED) and self.body[end] in (APART, JOINED):
                start, stop = self.starts[bisect_left(self.offsets, at - 1)], self.stops[bisect_left(self.offsets, end) - 1]
                if not (self.text[start - 1 : start].isalnum() or self.text[stop : stop + 1].isalnum()):
                    return start, stop
            at = self.body.find(needle, at + 1)
        return None

    def _closed(self, start: int, stop: int, last: str) -> int:
        """The end of a span with what belongs to it: emphasis that it opens, and its final punctuation."""
        mark = re.compile(r"\*\*|`").match(self.text, stop)
        if mark and self.text.count(mark[0], start, stop) % 2:
            stop = mark.end()
        return stop + (last in ".!?" and self.text[stop : stop + 1] == last)


def find_quote(text: str | None, quote: str | None, after: int = 0) -> tuple[int, int] | None:
    """Source(text).find(quote); None where either is null or empty."""
    return Source(text).find(quote, after) if text and quote and quote.strip() else None


@F.arrow_udf(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))
def find_quote_udf(texts: pa.Array, quotes: pa.Array) -> pa.Array:
    """find_quote() of each row.  The texts and quotes of a batch are cut once each, and a pair of them is looked for once; only a
    text that has the tokens of a quote gets their places."""
    text, quote = (x.dictionary_encode() for x in (texts, quotes))
    some, asked = text.dictionary.to_pylist(), quote.dictionary.to_pylist()
    a, b = (pc.fill_null(x.indices, len(y)).to_numpy(zero_copy_only=False).astype(np.int64) for x, y in ((text, some), (quote, asked)))
    pairs, back = np.unique(a * (len(asked) + 1) + b, return_inverse=True)
    bodies, made, source = _bodies(some), needles(asked), None
    spans = []
    for i, j in zip(*(x.tolist() for x in np.divmod(pairs, len(asked) + 1))):
        span = None
        if i < len(some) and j < len(asked) and asked[j].strip() and made[j] in bodies[i]:
            source = source if source and source.text is some[i] else Source(some[i])
            span = source.find(asked[j], 0, made[j])
        spans.append(span or (None, None))
    start, end = (pa.array(x, pa.int32()).take(pa.array(back)) for x in zip(*spans)) if spans else [pa.array([], pa.int32())] * 2
    return pa.StructArray.from_arrays([start, end], ["start", "end"])
