"""Records of JSON documents that don't fit into memory as a whole."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

_BLANK = re.compile(r"[ \t\r\n]*")
_OUTSIDE, _INSIDE = re.compile(r'["{}\[\],]'), re.compile(r'["\\]')
#: An error this close to the end of what was read may go away with more text.
_NEAR_END = 32


class _Text:
    """A text that arrives in pieces; what was taken from it is let go."""

    def __init__(self, pieces: Iterator[str]):
        self.pieces, self.held, self.at, self.decoder = pieces, "", 0, json.JSONDecoder()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held, self.at = self.held[self.at :] + piece, 0
        return piece is not None

    def peek(self) -> str:
        """The next sign that isn't white space; none at the end."""
        while True:
            self.at = _BLANK.match(self.held, self.at).end()
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                return ""

    def need(self, sign: str, what: str) -> None:
        if self.peek() != sign:
            raise ValueError(what)
        self.at += 1

    def value(self) -> Any:
        """Decode the next value; tried anew only when twice as much text is there."""
        while True:
            try:
                value, stop = self.decoder.raw_decode(self.held, self.at)
                if stop < len(self.held):  # a number could go on in the next piece
                    self.at = stop
                    return value
                failure = None
            except json.JSONDecodeError as error:
                failure = error
                if not error.msg.startswith("Unterminated string") and error.pos < len(self.held) - _NEAR_END:
                    raise
            wanted = 2 * (len(self.held) - self.at)
            grown = False
            while len(self.held) - self.at < wanted and self.more():
                grown = True
            if not grown:
                if failure is not None:
                    raise failure
                self.at = stop
                return value

    def skip(self) -> None:
        """Pass over the next value without decoding it."""
        depth, quoted = 0, False
        while True:
            m = (_INSIDE if quoted else _OUTSIDE).search(self.held, self.at)
            if m is None:
                self.at = len(self.held)
                if not self.more():
                    raise ValueError("the document ends too early")
                continue
            sign = m[0]
            if not quoted and not depth and sign in ",}]":
                self.at = m.start()  # it belongs to what is around the value
                return
            self.at = m.end()
            if sign == "\\":
                while self.at >= len(self.held):
                    if not self.more():
                        raise ValueError("the document ends too early")
                self.at += 1
            elif sign == '"':
                quoted = not quoted
            elif sign in "{[":
                depth += 1
            elif sign in "}]":
                depth -= 1
            if not quoted and not depth and sign in '"}]':
                return


def documents(text: Iterator[str]) -> Iterator[Any]:
    """The elements of the top-level ``Records`` of each JSON document of a stream, decoded one at a time.

    Other keys are passed over, whatever they hold. A stream that doesn't begin with an object has none.
    Raises ValueError where a later document is no object, ``Records`` is no array, an element is damaged,
    or the stream ends inside a document.
    """
    s = _Text(text)
    if s.peek() != "{":
        return
    while s.peek():
        s.need("{", "a document is no object")
        while (sign := s.peek()) != "}":
            if sign == ",":
                s.at += 1
                continue
            if sign != '"':
                raise ValueError("a key is missing" if sign else "the document ends too early")
            key = s.value()
            s.need(":", "a key has no value")
            if key != "Records":
                if not s.peek():
                    raise ValueError("the document ends too early")
                s.skip()
                continue
            s.need("[", "Records is no array")
            while (sign := s.peek()) != "]":
                if sign == ",":
                    s.at += 1
                elif sign:
                    yield s.value()
                else:
                    raise ValueError("the document ends too early")
            s.at += 1
        s.at += 1
