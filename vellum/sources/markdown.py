"""A line-oriented Markdown reader: headings, links, wiki links and code, with their lines.

Covered: ATX and setext headings, fenced and indented code, block quotes and lists around them,
inline code over several lines, inline links, autolinks in angle brackets, bare http(s), www and
mail ones, link definitions. A reference-style link names a definition and holds no URL of its
own, so it is no link here, and neither is its definition. Not covered: nested HTML blocks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..config import Limits
from . import frontmatter

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r" {0,3}(?:[-*+]|[0-9]{1,9}[.)])(?: {1,4}|\t|$)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_HTML = re.compile(r" {0,3}<(?:/?(?:script|pre|style|textarea|table|div|p|ul|ol|li|h[1-6]|iframe|form|section|article|details|summary|center|hr|td|tr|th)\b|!--|\?|![A-Z])", re.IGNORECASE)
_WIKI = re.compile(r"\[\[([^\]]+)\]\]")
_LINK = re.compile(r"""(?<![!\\])\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|\(([^()]*)\)))?\s*\)""")
_ANGLE = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
_BARE = re.compile(r"(?<![A-Za-z0-9_/\"'=])(?:https?://|www\.)[^\s<]+")
_MAIL = re.compile(r"(?<![A-Za-z0-9._+/:@-])[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z0-9_-]*[A-Za-z0-9](?![A-Za-z0-9@_-])")
_DEFINITION = re.compile(r"""\s{0,3}\[(?!\^)(?:[^\[\]\\]|\\.)+\]:\s*(?:<[^<>\n]*>|[^\s<]\S*)(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\([^()]*\)))?\s*$""")
_TICKS = re.compile(r"`+")


class BudgetError(ValueError):
    """A document has more nodes, or nests deeper, than the parser allows."""


@dataclass
class _Found:
    headings: list[dict[str, Any]] = field(default_factory=list)
    links: list[dict[str, Any]] = field(default_factory=list)
    blocks: list[dict[str, Any]] = field(default_factory=list)
    spans: list[dict[str, Any]] = field(default_factory=list)
    nodes: int = 1

    def count(self, n: int = 1) -> None:
        self.nodes += n
        if self.nodes > Limits.AST_NODES:
            raise BudgetError(f"Markdown has more than {Limits.AST_NODES} nodes.")


def code_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and value of each inline code span."""
    runs = [m.span() for m in _TICKS.finditer(text)]
    spans, k = [], 0
    while k < len(runs):
        a, b = runs[k]
        if a and text[a - 1] == "\\":
            k += 1
            continue
        close = next((j for j in range(k + 1, len(runs)) if runs[j][1] - runs[j][0] == b - a), None)
        if close is None:
            k += 1
            continue
        value = text[b : runs[close][0]].replace("\n", " ")
        if len(value) > 2 and value[0] == value[-1] == " " and value.strip():
            value = value[1:-1]
        spans.append((a, runs[close][1], value))
        k = close + 1
    return spans


def plain(text: str) -> str:
    """What a heading or link label says without its markup."""
    parts, at = [], 0
    for a, b, value in code_spans(text):
        parts += [_unmarked(text[at:a]), value]
        at = b
    return "".join([*parts, _unmarked(text[at:])]).strip()


def _unmarked(text: str) -> str:
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    text = _LINK.sub(lambda m: m[1], text)
    text = _ANGLE.sub(lambda m: m[1], text)
    text = re.sub(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"\*(?=\S)(.+?)(?<=\S)\*", r"\1", text)
    text = re.sub(r"(?<![A-Za-z0-9_])_(?=\S)(.+?)(?<=\S)_(?![A-Za-z0-9_])", r"\1", text)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)


def _inline(found: _Found, lines: list[tuple[int, int, str]]) -> None:
    """Code spans and links of one paragraph; lines: number, first column, content."""
    text = "\n".join(content for _, _, content in lines)
    starts = [0]
    for _, _, content in lines[:-1]:
        starts.append(starts[-1] + len(content) + 1)

    def where(offset: int) -> tuple[int, int]:
        k = max(i for i, s in enumerate(starts) if s <= offset)
        return lines[k][0], lines[k][1] + offset - starts[k]

    found.count(2)
    spans = code_spans(text)
    for a, b, value in spans:
        (line, column), (end, end_column) = where(a), where(b)
        found.spans.append({"value": value, "line": line, "column": column, "end": end, "end_column": end_column})
        found.count(2)
    hidden = list(text)
    for a, b, _ in spans:
        hidden[a:b] = "\x00" * (b - a)
    masked = "".join(hidden)
    taken = []
    for m in _LINK.finditer(masked):
        url = m[2] if m[2] is not None else m[3]
        taken.append(m.span())
        found.count(2)
        if url:
            found.links.append({"text": plain(text[m.start(1) : m.end(1)]), "url": re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", url), "title": m[4] or m[5] or m[6], "line": where(m.start())[0]})
    for pattern in (_ANGLE, _BARE, _MAIL):
        for m in pattern.finditer(masked):
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            taken.append(m.span())
            label = m[1] if pattern is _ANGLE else _without_tail(m[0]) if pattern is _BARE else m[0]
            scheme = "" if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", label) else "mailto:" if "@" in label else "http://"
            found.links.append({"text": label, "url": scheme + label, "title": None, "line": where(m.start())[0]})
            found.count(2)
    found.links.sort(key=lambda x: x["line"])


def _without_tail(url: str) -> str:
    """A bare link without the marks that end its sentence; a closing bracket stays if it was opened."""
    while url and (url[-1] in "?!.,:*_~'\"" or (url[-1] == ")" and url.count(")") > url.count("("))):
        url = url[:-1]
    return url


def _blocks(body: list[str]) -> _Found:
    found = _Found()
    paragraph: list[tuple[int, int, str]] = []
    fence: tuple[str, int, str, list[str], int] | None = None
    indented: list[tuple[int, str]] = []
    in_list = html = False

    def drop_definitions() -> None:
        while paragraph and _DEFINITION.match(paragraph[0][2]):
            paragraph.pop(0)
            found.count()

    def end_paragraph() -> None:
        drop_definitions()
        if paragraph:
            _inline(found, paragraph)
            paragraph.clear()

    def end_indented() -> None:
        while indented and not indented[-1][1].strip():
            indented.pop()
        if indented:
            found.blocks.append({"language": None, "value": "\n".join(x for _, x in indented), "line": indented[0][0], "end": indented[-1][0]})
            found.count()
        indented.clear()

    for n, line in enumerate(body, 1):
        content, depth = line, 0
        if fence:
            mark, start, language, kept, quotes = fence
            for _ in range(quotes):
                content = _QUOTE.sub("", content, count=1)
            close = _FENCE.match(re.sub(r"^\s+(?=[`~])", "", content))
            if close and close[1][0] == mark[0] and len(close[1]) >= len(mark) and not close[2].strip():
                found.blocks.append({"language": language or None, "value": "\n".join(kept), "line": start, "end": n})
                found.count()
                fence = None
            else:
                kept.append(content)
            continue
        column, quoted = 1, False
        while True:
            m = _QUOTE.match(content)
            quoted = quoted or bool(m)
            if not m and not paragraph and not _RULE.match(content):
                m = _ITEM.match(content)
                if m:
                    in_list = in_list or not quoted
                    found.count(2)
            if not m or not m.end():
                break
            if _ITEM.match(content) and paragraph:
                end_paragraph()
            column += m.end()
            content = content[m.end() :]
            depth += 1
            if depth > Limits.AST_DEPTH:
                raise BudgetError(f"Markdown nests deeper than {Limits.AST_DEPTH}.")
        if paragraph and not depth and _ITEM.match(content) and not _RULE.match(content) and content.strip() not in ("-", "*", "+"):
            end_paragraph()
            m = _ITEM.match(content)
            column += m.end()
            content = content[m.end() :]
            in_list = True
            found.count(2)
        if not content.strip():
            end_paragraph()
            html = False
            if indented:
                indented.append((n, ""))
            continue
        if not depth and in_list and not content.startswith((" ", "\t")) and not paragraph and not _ITEM.match(line):
            in_list = False
        if not paragraph and not in_list and not depth and re.match(r"(?: {4}|\t)", content):
            indented.append((n, re.sub(r"^(?: {4}|\t)", "", content)))
            continue
        end_indented()
        if in_list and not depth:
            stripped = content.lstrip()
            column += len(content) - len(stripped)
            content = stripped
        if opened := _FENCE.match(content):
            if opened[1][0] == "~" or "`" not in opened[2]:
                end_paragraph()
                fence = (opened[1], n, opened[2].strip().split(" ")[0], [], line[: len(line) - len(content)].count(">"))
                continue
        if m := _ATX.match(content):
            end_paragraph()
            label = m[2] or ""
            found.headings.append({"text": plain(label), "depth": len(m[1]), "line": n})
            _inline(found, [(n, column, content)])
            continue
        if paragraph and not html and _SETEXT.match(content):
            drop_definitions()
        if paragraph and not html and (m := _SETEXT.match(content)):
            label = "\n".join(c.strip() for _, _, c in paragraph)
            found.headings.append({"text": plain(label), "depth": 1 if m[1][0] == "=" else 2, "line": paragraph[0][0]})
            end_paragraph()
            continue
        if _RULE.match(content):
            end_paragraph()
            found.count()
            continue
        if html or (not paragraph and _HTML.match(content)):
            html = True
            found.count()
            continue
        paragraph.append((n, column, content))
    if fence:
        found.blocks.append({"language": fence[2] or None, "value": "\n".join(fence[3]), "line": fence[1], "end": len(body)})
        found.count()
    end_indented()
    end_paragraph()
    return found


def wiki_target(value: str) -> tuple[str, str | None, str | None]:
    """Target, anchor and alias of what stands between double brackets."""
    head, *rest = (p.strip() for p in value.split("|"))
    target, *anchor = (p.strip() for p in head.split("#"))
    return target, (anchor[0] or None) if anchor else None, (rest[0] or None) if rest else None


def _wiki_links(body: list[str], found: _Found) -> list[dict[str, Any]]:
    fenced = {n for b in found.blocks for n in range(b["line"], b["end"] + 1)}
    out = []
    for n, line in enumerate(body, 1):
        if n in fenced or "[[" not in line:
            continue
        for m in _WIKI.finditer(line):
            a, b = m.start() + 1, m.end() + 1
            if any(
                s["line"] <= n <= s["end"] and (a < s["end_column"] or n < s["end"]) and (b > s["column"] or n > s["line"])
                for s in found.spans
            ):
                continue
            target, anchor, alias = wiki_target(m[1])
            if target:
                out.append({"raw": m[0], "target": target, "anchor": anchor, "alias": alias, "line": n})
    return out


def parse(raw: str) -> dict[str, Any]:
    """Everything a document says; lines count from the start of the file. Raises BudgetError."""
    block = frontmatter.split(raw)
    body = re.split(r"\r?\n", block.body)
    found = _blocks(body)
    shift = block.line_offset
    headings = [h for h in sorted(found.headings, key=lambda h: h["line"]) if h["depth"] <= 4]
    sections = []
    for i, h in enumerate(headings):
        end = headings[i + 1]["line"] - 1 if i + 1 < len(headings) else len(body)
        sections.append({"heading": h["text"], "level": h["depth"], "start_line": h["line"] + shift, "end_line": end + shift, "content": "\n".join(body[h["line"] - 1 : max(end, h["line"] - 1)])})
    if not headings:
        sections = [{"heading": None, "level": 1, "start_line": shift + 1, "end_line": shift + len(body), "content": "\n".join(body)}]
    blocks = [{"language": b["language"], "value": b["value"], "line": b["line"], "inline": False} for b in found.blocks]
    spans = [{"language": None, "value": s["value"], "line": s["line"], "inline": True} for s in found.spans]
    parsed = {
        "body": block.body,
        "body_line_offset": shift,
        "front": frontmatter.normalise(block.data),
        "diagnostics": block.diagnostics,
        "first_h1": next((h["text"] for h in headings if h["depth"] == 1), None),
        "sections": sections,
        "md_links": found.links,
        "wiki_links": _wiki_links(body, found),
        "code": spans + blocks,
    }
    for name in ("md_links", "wiki_links", "code"):
        for item in parsed[name]:
            item["line"] += shift
    return parsed
