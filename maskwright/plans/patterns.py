"""Filter lists: reading, checking and preparing patterns on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

#: Names of filter types, of types of identifiers, and of sides of a context.
TYPES = ("regex", "set", "dynamic_set", "regex_context", "dynamic_regex", "dynamic_regex_context", "stanford_ner", "pos_matcher", "match_all")
PHI_TYPES = ("HOLIDAYS", "DATE", "ID", "NAME", "CONTACT", "AGE>=90", "AGE<90", "OTHER", "LOCATION", "PROBE", "PROBEREGEX", "PROBEDYNAMICSET", "PROBEREGEXCONTEXT", "TOWN")
CONTEXTS = ("left", "right", "left_or_right", "left_and_right")

#: Filter types of callers: name to a function of (text, pattern) that gives the (start, stop) pairs found in a text.
FINDERS: dict = {}


def register(name: str, find) -> None:
    """Add a filter type. find(text, pattern) runs in the Arrow step that resolves notes; its spans are accepted like those of a regex."""
    if name in TYPES:
        raise ValueError(f"{name} is a filter type already")
    FINDERS[name] = find


@dataclass(frozen=True)
class Pattern:
    """One filter. regex is the source of the regex types, words those of a set; probes come per note."""

    title: str
    type: str
    exclude: bool
    phi_type: str = "OTHER"
    regex: str | None = None
    words: tuple[str, ...] = ()
    pos: tuple[str, ...] = ()
    context: str | None = None
    context_filter: str = "all"
    notes: str = field(default="", compare=False)

    def __post_init__(self):
        if self.type not in TYPES and self.type not in FINDERS:
            raise ValueError(f"{self.title}: unknown type {self.type}")
        if not isinstance(self.exclude, bool):
            raise ValueError(f"{self.title}: exclude must be true or false")
        if self.phi_type not in PHI_TYPES:
            raise ValueError(f"{self.title}: unknown phi_type {self.phi_type}")
        if self.type in ("regex", "regex_context", "dynamic_regex", "dynamic_regex_context") and not self.regex:
            raise ValueError(f"{self.title}: no regex")
        if "context" in self.type and self.context not in CONTEXTS:
            raise ValueError(f"{self.title}: context must be one of {', '.join(CONTEXTS)}")
        if self.type == "pos_matcher" and not self.pos:
            raise ValueError(f"{self.title}: no pos")


def regex_line(text: str) -> str:
    """The pattern in a regex file: its last line that isn't a comment."""
    lines = [x.strip("\r") for x in text.split("\n") if x.strip() and not x.startswith("#")]
    return lines[-1].strip() if lines else ""


def expand(template: str, macros: dict[str, str]) -> str:
    '''Put macros in for \"\"\"+name+r\"\"\"; an unknown name is an error.'''

    def one(m: re.Match) -> str:
        if m[1] not in macros:
            raise ValueError(f"unknown macro {m[1]}")
        return macros[m[1]]

    return re.sub(r'"""\s*\+\s*(\w+)\s*\+\s*r"""', one, template)


def jvm_regex(source: str) -> str:
    """source for the JVM with the meaning it has in Python: inline case flags in front, Unicode classes, \\n as the only line end."""
    body = source.replace("(?i)", "")
    return f"(?Ud){'(?i)' if body != source else ''}{body}"


def load(config: str, read=None) -> list[Pattern]:
    """Patterns of a JSON list, in order of priority. read gives the text of a file that a pattern names."""
    out, seen = [], set()
    for x in json.loads(config):
        if x["title"] in seen:
            raise ValueError(f"title {x['title']} occurs twice")
        seen.add(x["title"])
        text = read(x["filepath"]) if "filepath" in x and read else None
        regex = x.get("regex") or (regex_line(text) if text is not None and "regex" in x["type"] else None)
        if regex and "dynamic" in x["type"]:
            regex = re.sub(r'"""\s*\+\s*probe\s*\+\s*r"""', "%s", regex).replace("(?i)", "")
        words = x.get("words") or (json.loads(text) if text is not None and x["type"] == "set" else ())
        out.append(Pattern(x["title"], x["type"], x["exclude"], x.get("phi_type", "OTHER"), regex, tuple(words), tuple(x.get("pos", ())), x.get("context"), x.get("context_filter", "all"), x.get("notes", "")))
    for p in out:
        if p.context_filter != "all" and p.context_filter not in seen:
            raise ValueError(f"{p.title}: context_filter {p.context_filter} names no pattern")
    return out
