"""The line protocol of a spell-checking pipe: commands change the speller, other lines are checked.

``*w`` adds to the personal list, ``&w`` its lower case, ``@w`` to the session; ``#`` saves; ``+mode`` and ``-`` set and
reset the filter mode; ``!`` and ``%`` switch terse output on and off; ``$$ra m,c`` stores a replacement; ``$$cs k,v`` and
``$$cr k`` set and read an option; ``$$pp`` and ``$$ps`` list personal and session words; ``$$l`` tells the language;
``^`` takes the rest as text whatever it starts with; ``~`` is accepted and ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from quillspark.session import Speller


@dataclass
class Pipe:
    speller: Speller
    personal_path: str | None = None
    terse: bool = False
    log: list[tuple[str, int, str, str]] = field(default_factory=list)

    def line(self, text: str) -> list[str]:
        """The answer to one line: nothing for commands, protocol lines and an empty line for text."""
        head, rest = text[:1], text[1:].strip()
        if text.startswith("$$"):
            return self._extended(text[2:])
        if head in ("*", "&") and rest:
            self.speller = self.speller.add_to_personal([rest.lower() if head == "&" else rest])
        elif head == "@" and rest:
            self.speller = self.speller.add_to_session([rest])
        elif head == "#":
            if self.personal_path:
                self.speller.save_all(self.personal_path)
        elif head == "+":
            self.speller = self.speller.with_options(mode=rest or "url")
        elif head == "-":
            self.speller = self.speller.with_options(mode="url")
        elif head in ("!", "%"):
            self.terse = head == "!"
        elif head != "~":
            return self.check(text[1:] if head == "^" else text)
        return []

    def _extended(self, command: str) -> list[str]:
        name, rest = command[:2], command[2:].strip()
        if command.startswith("l"):
            return [self.speller.language.name]
        if name == "ra":
            mis, _, cor = rest.partition(",")
            self.log.append(("pipe", len(self.log), mis.strip(), cor.strip()))
            self.speller = self.speller.store_replacements(self.speller.spark.createDataFrame(self.log, "user string, at int, mis string, cor string"))
        elif name == "cs":
            key, _, value = rest.partition(",")
            self.speller = self.speller.with_options(**{key.strip(): value.strip()})
        elif name == "cr":
            return [str(self.speller.options[rest])]
        elif name in ("pp", "ps"):
            words = self.speller.personal if name == "pp" else self.speller.session
            listed = [r["word"] for r in words.select("word").orderBy("word").toLocalIterator()] if words is not None else []
            return [f"{len(listed)}: {', '.join(listed)}"]
        return []

    def check(self, text: str) -> list[str]:
        """Protocol lines of one line's tokens in order, and an empty line; terse output leaves out correct words."""
        docs = self.speller.spark.createDataFrame([(0, text)], "doc_id long, text string")
        rows = self.speller.report(docs).orderBy("offset").select("line").collect()
        return [*(r["line"] for r in rows if not (self.terse and r["line"][:1] in "*+-")), ""]
