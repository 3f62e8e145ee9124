"""Sections of article HTML, by the standard library's parser: nesting is beyond regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SKIPPED_TITLES

DROPPED = {"table", "sup", "style", "script"}
HEADINGS = {"h2", "h3"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "source", "track", "embed"}
MARK = "data-mw-section-id"


@dataclass
class Part:
    """A section, or the whole article: its number, the strings of its first heading, its strings, and how many dropped elements it lies in."""

    number: int
    inside: int = 0
    title: list[str] | None = None
    text: list[str] = field(default_factory=list)


class Sections(HTMLParser):
    """Every string goes to all sections that are open around it, unless an element inside the section drops it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.article = Part(0)
        self.lead: Part | None = None
        self.found: list[Part] = []
        self.open: list[Part] = [self.article]
        self.headings: list[list[str]] = []
        self.stack: list[tuple[str, Part | None, list[str] | None]] = []
        self.dropped, self.held = 0, ""

    def flush(self) -> None:
        """What was read since the last tag is one string; white space alone is a single character."""
        said, self.held = self.held, ""
        if not said:
            return
        if not said.strip():
            said = "\n" if "\n" in said else " "
        for heading in self.headings:
            heading.append(said)
        for part in self.open:
            if part.inside == self.dropped:
                part.text.append(said)

    def section(self, mark: str | None) -> Part | None:
        try:
            part = Part(int(mark or ""), self.dropped)
        except ValueError:
            return None
        if mark == "0" and self.lead is None:
            self.lead = part
        self.found.append(part)
        self.open.append(part)
        return part

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in VOID:
            return
        part = self.section(dict(attrs)[MARK]) if tag == "section" and MARK in dict(attrs) else None
        heading = None
        if tag in HEADINGS and any(p.title is None for p in self.open):
            heading = []
            self.headings.append(heading)
            for p in self.open:
                p.title = heading if p.title is None else p.title
        self.dropped += tag in DROPPED
        self.stack.append((tag, part, heading))

    def handle_endtag(self, tag):
        self.flush()
        while any(t == tag for t, *_ in self.stack):
            name, part, heading = self.stack.pop()
            self.dropped -= name in DROPPED
            if part is not None:
                self.open.pop()
            if heading is not None:
                self.headings.pop()
            if name == tag:
                break

    def handle_data(self, data):
        self.held += data

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            self.held = data[6:]
            self.flush()


def clean(parts: list[str]) -> str:
    text = " ".join(parts)
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", text)
    return re.sub(r"\s+", " ", re.sub(r"\[\d+\]", "", text)).strip()


def split(html: str | None) -> list[tuple[int, str, str]]:
    """(section_id, title, text) in the article's order. The lead is 0 and has no title; it is the first section marked 0 or, where
    there is none, the whole article. The others are those with a number above 0: a section's text holds its headings and the
    sections inside it, its title is the first heading in it. Those without text or with a skipped title are left out."""
    p = Sections()
    p.feed(html or "")
    p.close()
    p.flush()
    lead = clean((p.lead or p.article).text)
    out = [(0, "", lead)] if lead else []
    for s in p.found:
        title, text = " ".join(s.title or []).strip(), clean(s.text)
        if s.number > 0 and text and title.lower() not in SKIPPED_TITLES:
            out.append((s.number, title, text))
    return out


def sections(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, section_id, section_title, section_text) of a table of pages; null pages and those without any text have no rows."""

    parse = F.udf(split, "array<struct<section_id:int,section_title:string,section_text:string>>", useArrow=True)
    return df.select(key, F.explode(parse(html)).alias("s")).select(key, "s.*")
