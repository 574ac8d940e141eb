"""Source and configuration text as assignments: names, and the literals and references that they get.

One lexer for many languages: it knows strings of all kinds, brackets, calls,
annotations, concatenations and alternatives, and where a value ends. What it
cannot tell apart it takes for a value, as a scan should.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

NAME = r"[A-Za-z_$][\w.\-]*+"
_ANNOTATION = r"(?::[ \t]*[A-Za-z_][\w.]*+(?:\[[^\]\n=]*\])?(?:[ \t]*\|[ \t]*\w++)*[ \t]*(?==(?!=)))?"

# where a value follows a name
STARTS = {
    "pair": re.compile(
        rf"""(?<![\w.\-$])(?P<name>{NAME})["']?\]?[ \t]*{_ANNOTATION}(?:===?|!==?|:=|=>|=|:(?!:))[ \t]*""", re.ASCII
    ),
    "flag": re.compile(rf"(?<![\w\-])--(?P<name>{NAME})[ \t]+(?=[^\s\-])", re.ASCII),
    "tag": re.compile(rf"<(?P<name>{NAME})>(?=[^<\s])", re.ASCII),
    "define": re.compile(rf"#[ \t]*define[ \t]+(?P<name>{NAME})[ \t]+(?=\S)", re.ASCII),
    "many": re.compile(rf"(?m)^[ \t]*(?P<name>{NAME}(?:[ \t]*,[ \t]*{NAME})+)[ \t]*=(?!=)[ \t]*", re.ASCII),
    "call": re.compile(rf"""(?<![\w.\-$])(?P<name>{NAME})(?=\([ \t\r\n]*["'`])""", re.ASCII),
    "quoted": re.compile(rf"""["'](?P<name>{NAME})["'][ \t]*,[ \t]*(?=["'`])""", re.ASCII),
    "attribute": re.compile(
        rf"""\b(?:key|name|id)[ \t]*=[ \t]*["'](?P<name>{NAME})["'][^<>\n]{{0,200}}?\b(?:value|content)[ \t]*=[ \t]*(?=["'])""", re.ASCII
    ),
}
DEFINING = ("pair", "tag", "define", "many")  # the others hand a value on, and no name stands for it afterwards

TOKEN = re.compile(
    r"(?P<space>[ \t]+|\\\n)|(?P<line>\r?\n)"
    r"|(?P<string>[fFrRbBuU]{0,2}(?:(?P<qqq>\"\"\"|''')(?P<long>(?s:.*?))(?P=qqq)|(?P<q>[\"'`])(?P<text>(?:(?!(?P=q))[^\\\n]|\\.)*+)(?P=q)))"
    r"|\$?\{(?P<ref>[A-Za-z_]\w*+)\}"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<comma>,)|(?P<plus>\+(?!\S*[\w/=])|\+(?=[\"'`])|\.\.)"
    r"|(?P<other>\|\||\?\?|&&|=>|[?=;|&<>])|(?P<bare>[^\s\"'`,;(){}\[\]<>|&]++)",
    re.ASCII,
)
REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*)\}?|\{([A-Za-z_]\w*)\}", re.ASCII)
NEXT_LINE = re.compile(r"[ \t]*(?:[\"'`]|[^\s\"'`:=,;(){}\[\]#]++[ \t\r]*(?:\n|\Z))")
BLOCK = re.compile(r"[|>][+-]?[ \t]*(?=\r?\n)")
FUNCTION = re.compile(r"(?:(?:export|public|private|protected|static|async|final|pub|local)\s+)*(?:def|function|func|fn|sub|class)\b")
ELSE = {"or", "and", "if", "else", "unless"}
NOTHING = {"None", "null", "nil", "undefined", "new", "await", "return", "not"}


@dataclass(frozen=True)
class Literal:
    start: int
    end: int
    value: str
    certain: bool = True  # a bare word may be a name as well


Term = Literal | str  # a reference is the name it has


@dataclass
class Assignment:
    names: list[str]
    at: int
    kind: str
    path: tuple[int, ...]  # the functions it stands in, the outermost first


def scopes(text: str) -> tuple[list[int], list[tuple[int, ...]]]:
    """Where lines begin, and the functions each stands in, by indentation. Blank lines belong to those before."""
    starts, paths, open_ones = [], [], [(-1, 0)]
    for number, line in enumerate(re.finditer(r"(?m)^([ \t]*)(?=\S)", text), 1):
        indent = len(line[1].expandtabs(8))
        while len(open_ones) > 1 and open_ones[-1][0] >= indent:
            open_ones.pop()
        starts.append(line.start())
        paths.append(tuple(n for _, n in open_ones))
        if FUNCTION.match(text, line.end()):
            open_ones.append((indent, number))
    return starts, paths


def assignments(text: str) -> Iterator[Assignment]:
    """All of them, in the order of their values."""
    found = {}
    for kind, pattern in STARTS.items():
        for m in pattern.finditer(text):
            found[m.end()] = m["name"], kind  # of two at one place the later kind knows better
    starts, paths = scopes(text) if found else ([], [])
    for at, (name, kind) in sorted(found.items(), key=itemgetter(0)):
        path = paths[max(bisect_right(starts, at) - 1, 0)] if paths else (0,)
        yield Assignment(re.split(r"[ \t]*,[ \t]*", name) if kind == "many" else [name], at, kind, path)


def values(text: str, at: int, many: bool = False, deep: bool = True) -> list[tuple[int, list[Term]]]:
    """The values that begin at a place, each as its terms in order, with its place among values between commas.

    ``many`` goes on behind commas; ``deep`` looks into brackets of all kinds,
    and else only into round ones. Keys of a mapping are no values.
    """
    found: list[tuple[int, list[Term]]] = []
    terms: list[Term] = []
    depth, place, wanting = 0, 0, True  # wanting: a term may follow

    def ended() -> None:
        nonlocal terms
        if terms:
            found.append((place, terms))
        terms = []

    if block := BLOCK.match(text, at):
        at = block.end()
    while token := TOKEN.match(text, at):
        kind, before, at = token.lastgroup, at, token.end()
        if kind == "space":
            continue
        if kind == "line":
            if depth or (wanting and (terms or NEXT_LINE.match(text, at))):
                continue
            break
        if kind == "string":
            group = "long" if token["qqq"] else "text"
            start, end = token.span(group)
            if not wanting and not (terms and text[before - 1 : before] in " \t\n"):
                ended()
            if depth and re.compile(r"[ \t]*:(?!:)").match(text, at):
                at = text.index(":", at) + 1  # a key
                ended()
                wanting = True
                continue
            inner = token[group]
            terms.append(Literal(start, end, REFERENCE.sub("", inner)))
            terms += [m[1] or m[2] for m in REFERENCE.finditer(inner)]
            wanting = False
        elif kind == "ref":
            terms.append(token["ref"])
            wanting = False
        elif kind == "bare":
            word = token["bare"]
            if word in ELSE or word in NOTHING:
                ended()
                wanting = wanting or word in ELSE
                continue
            if depth and word.startswith(("#", "//")):
                at = (text.find("\n", at) + 1 or len(text) + 1) - 1
                continue
            if not wanting:
                if not depth:
                    break
                ended()
            if text[at : at + 1] != "(":
                word = word.lstrip("$")
                terms.append(word if depth else Literal(*token.span("bare"), word, certain=False))
            wanting = False
        elif kind == "plus":
            wanting = True
        elif kind == "comma":
            ended()
            if not depth:
                if not many:
                    break
                place += 1
            wanting = True
        elif kind == "open":
            if not deep and token["open"] != "(":
                break
            if not wanting and terms:
                ended()
            depth, wanting = depth + 1, True
        elif kind == "close":
            ended()
            depth, wanting = depth - 1, False
            if depth < 0:
                break
        else:
            if token["other"] in (";", "|", "&", "<", ">") and not depth:
                break
            ended()
            wanting = True
    ended()
    return found
