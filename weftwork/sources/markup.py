"""Reading XML as a run of parser events with their places in the bytes, so that documents can be changed where they must be."""

from __future__ import annotations

from xml.parsers import expat


class Refused(ValueError):
    """A document with a document type, which is not read."""


def local(name: str) -> str:
    """A name without its name space."""
    return name.rpartition(" ")[2]


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def attribute(text: str) -> str:
    return escaped(text).replace('"', "&quot;")


def run(document: str | None, reader) -> bool:
    """Feed ``reader`` (start, end, text) with the events of a document; False if it is no XML or has a document type.

    The reader's ``at`` is the place of the event's first byte in the document as UTF-8.
    """
    if not document:
        return False
    parser = expat.ParserCreate("utf-8", " ")
    parser.buffer_text = True

    def start(name: str, attributes: dict[str, str]) -> None:
        reader.at = parser.CurrentByteIndex
        reader.start(local(name), {local(k): v for k, v in attributes.items()})

    def end(name: str) -> None:
        reader.at = parser.CurrentByteIndex
        reader.end(local(name))

    def refuse(*_: object) -> None:
        raise Refused

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, reader.text
    parser.StartDoctypeDeclHandler = refuse
    try:
        parser.Parse(document.encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, Refused):
        return False
    return True


class _Deaf:
    at = 0

    def start(self, name: str, attributes: dict[str, str]) -> None: ...

    def end(self, name: str) -> None: ...

    def text(self, data: str) -> None: ...


def well_formed(inside: str) -> bool:
    """Whether a text may stand inside an element as it is."""
    return run(f"<x>{inside}</x>", _Deaf())


class Copy:
    """What stands inside an element, written anew from its events: no name spaces, text escaped, empty elements closed at once."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.open = False

    def _close_tag(self, mark: str = ">") -> None:
        if self.open:
            self.parts.append(mark)
            self.open = False

    def start(self, name: str, attributes: dict[str, str]) -> None:
        self._close_tag()
        self.parts.append("<" + name)
        for k, v in attributes.items():
            value = v.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
            self.parts.append(f' {k}="{value}"')
        self.open = True

    def end(self, name: str) -> None:
        if self.open:
            self._close_tag("/>")
        else:
            self.parts.append(f"</{name}>")

    def text(self, data: str) -> None:
        if data:
            self._close_tag()
            self.parts.append(escaped(data))

    def __str__(self) -> str:
        return "".join(self.parts)
