"""Pages of HTML as tables: title, text, table of contents, API entities.

A page becomes a small element tree (the standard library's tokenizer), which
is read in one pass for all outputs.  Pages are independent rows of one Arrow
function; malformed markup never fails.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urldefrag, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.session import workers
from docloom.functions.text import CHANGE_PATTERN, DEPRECATED_PATTERN, INLINE_RULES, MODIFIER_PATTERN, PARAMETER_PATTERN

# --- the tree -----------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold text.
_SILENT = frozenset("script style noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("section article main div dd body".split())


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: "Node | None" = None
    children: list["Node | str"] = field(default_factory=list)

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    @property
    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator["Node"]:
        """All elements below, in document order."""
        stack = self.elements[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements[::-1])

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = self.children[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack.extend(x.children[::-1])

    def first(self, test: Callable[["Node"], bool]) -> "Node | None":
        return next(filter(test, self.walk()), None)

    def child(self, *tags: str) -> "Node | None":
        return next((c for c in self.elements if c.tag in tags), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(page: str) -> Node:
    """The page's elements without scripts, styles and links to headings. Comments are dropped."""
    builder = _Builder()
    builder.feed(page)
    builder.close()

    def prune(node: Node) -> None:
        stack = [node]
        while stack:
            n = stack.pop()
            n.children = [c for c in n.children if isinstance(c, str) or not (c.tag in _SILENT or (c.tag == "a" and "headerlink" in c.classes))]
            stack.extend(n.elements)

    prune(builder.root)
    return builder.root


#: Where the main content is looked for, in turn.
_MAIN: tuple[Callable[[Node], bool], ...] = (
    lambda n: n.tag == "div" and "rst-content" in n.classes,
    lambda n: n.tag == "div" and n.attrs.get("itemprop") == "articleBody",
    lambda n: n.tag == "div" and "document" in n.classes,
    lambda n: n.tag == "article",
    lambda n: n.tag == "main",
    lambda n: n.attrs.get("role") == "main",
)


def main_content(root: Node) -> Node:
    for test in (*_MAIN, lambda n: n.tag == "body"):
        found = root.first(test)
        if found is not None:
            return found
    return root


# --- text ------------------------------------------------------------------------

_RULES = [(re.compile(p), r.replace("$1", r"\1")) for p, r in INLINE_RULES]


def normal(text: str, compact: bool = False) -> str:
    """Normalised running text; see ``functions.text.inline``."""
    out = " ".join(text.replace("¶", " ").split())
    for pattern, to in _RULES:
        out = pattern.sub(to, out)
    if compact:
        out = re.sub(r"\s+([(\[{])", r"\1", out)
    return " ".join(out.split())


def inline(node: Node, compact: bool = False) -> str:
    return normal(" ".join(s.strip() for s in node.strings() if s.strip()), compact)


def is_object(node: Node) -> bool:
    return node.tag == "dl" and "py" in node.classes


def is_field_list(node: Node) -> bool:
    return node.tag == "dl" and "field-list" in node.classes


class Renderer:
    """Blocks of text below a node. ``objects`` false leaves out API objects."""

    def __init__(self, objects: bool = True):
        self.objects = objects

    def _hides(self, node: Node) -> bool:
        """Whether the node must be opened up, to leave out objects in it."""
        return not self.objects and node.first(is_object) is not None

    def blocks(self, node: Node) -> Iterator[str]:
        if is_object(node):
            yield from self.object(node)
            return
        for c in node.children:
            yield from filter(None, [normal(c)] if isinstance(c, str) else self.block(c))

    def block(self, node: Node) -> Iterator[str]:
        if is_object(node):
            yield from self.object(node)
        elif is_field_list(node):
            yield self.fields(node)
        elif node.tag in ("ul", "ol"):
            yield from self.list(node)
        elif node.tag == "pre":
            yield "\n".join(node.strings()).strip()
        elif node.tag in _CONTAINERS or self._hides(node):
            yield from self.blocks(node)
        else:
            yield inline(node)

    def object(self, dl: Node) -> Iterator[str]:
        """A signature, then its description."""
        if self.objects:
            head = dl.child("dt")
            if head is not None:
                yield from filter(None, [inline(head, compact=True)])
            for dd in dl.elements:
                if dd.tag == "dd":
                    yield from self.blocks(dd)

    def list(self, node: Node) -> Iterator[str]:
        """Items; one with paragraphs gives these, then its nested lists."""
        for li in node.elements:
            if li.tag != "li":
                continue
            paragraphs = [c for c in li.elements if c.tag == "p"]
            for part in paragraphs or [li]:
                yield from filter(None, self.blocks(part) if self._hides(part) else [inline(part)])
            for c in li.elements if paragraphs else ():
                if c.tag in ("ul", "ol"):
                    yield from self.list(c)
                elif c.tag != "p" and self._hides(c):
                    yield from self.blocks(c)

    def pairs(self, dl: Node) -> Iterator[tuple[str, Node]]:
        """(label, value) of a field list."""
        parts = dl.elements
        for dt, dd in zip(parts[::2], parts[1::2]):
            label = inline(dt).rstrip(":")
            if dt.tag == "dt" and dd.tag == "dd" and label:
                yield label, dd

    def fields(self, dl: Node) -> str:
        lines: list[str] = []
        for label, dd in self.pairs(dl):
            if label.lower() == "parameters":
                found = parameter_items(dd)
            else:
                found = list(self.blocks(dd))
                if not found and not self._hides(dd):
                    found = [t for t in [inline(dd)] if t]
            if found:
                lines += [f"{label}:", *found]
        return "\n".join(lines).strip()

    def text(self, node: Node) -> str:
        return "\n\n".join(b for b in self.blocks(node) if b.strip())


def parameter_items(dd: Node) -> list[str]:
    """Items of a parameter field, with the type's bracket next to the name."""
    items = [re.sub(r"^([A-Za-z_][\w.]*)\s+\(", r"\1(", i) for ul in dd.elements if ul.tag in ("ul", "ol") for i in Renderer().list(ul)]
    return items or [t for t in [inline(dd)] if t]


def title_of(root: Node, url: str) -> str:
    """The title, else the first heading, else the URL's path."""
    plain = lambda n: "".join(s.strip() for s in n.strings())
    for tag in ("title", "h1"):
        node = root.first(lambda n: n.tag == tag)
        if node is not None and (tag == "h1" or plain(node)):
            return plain(node)
    return urlsplit(url).path


# --- table of contents ---------------------------------------------------------------


def _sections(node: Node) -> list[Node]:
    """Sections directly below, or else the topmost ones further down."""
    direct = [c for c in node.elements if c.tag == "section"]
    if direct:
        return direct
    found, stack = [], node.elements[::-1]
    while stack:
        n = stack.pop()
        if n.tag == "section":
            found.append(n)
        else:
            stack.extend(n.elements[::-1])
    return found


def contents(node: Node, url: str, level: int = 1) -> list[dict]:
    """Nested sections that have an id and a heading."""
    out = []
    for s in _sections(node):
        key, head = s.attrs.get("id", "").strip(), s.child(*HEADINGS)
        title = inline(head) if head is not None else ""
        if key and title:
            lead = s.child("p")
            out.append({"id": key, "title": title, "summary": inline(lead) if lead is not None else "", "level": level, "url": f"{url}#{key}", "children": contents(s, url, level + 1)})
    return out


# --- entities --------------------------------------------------------------------------

_MODIFIERS, _PARAMETER = re.compile(MODIFIER_PATTERN), re.compile(PARAMETER_PATTERN)
_CHANGED, _DEPRECATED = re.compile(CHANGE_PATTERN), re.compile(DEPRECATED_PATTERN)
#: Classes that mark a note, in the order they decide its kind.
NOTE_CLASSES = ("warning", "note", "versionadded", "versionchanged", "versionremoved", "deprecated", "admonition")


def canonical(url: str) -> str:
    """As ``functions.urls.canonical``, for one URL."""
    p = urlsplit(urldefrag(url)[0])
    path = re.sub(r"(?i)/index\.html$", "/", p.path or "/")
    query = urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() != "highlight"])
    return urlunsplit((p.scheme, p.netloc, path, query, ""))


def dotted_name(signature: str) -> str:
    return _MODIFIERS.sub("", signature.partition("(")[0].strip())


def _object_kind(dl: Node) -> str | None:
    if "class" in dl.classes:
        return "class"
    return "method" if dl.classes & {"method", "staticmethod", "classmethod"} else None


def _simple_name(sig: Node, signature: str, anchor: str | None) -> str:
    """The last part of the marked name, or of what else names the object."""
    marks = ({"sig-name"}, {"descname"})
    for node in sig.walk():
        inside = any(m & a.classes for m in marks for a in _ancestors(node, sig))
        if any(m & node.classes for m in marks) or ("pre" in node.classes and inside):
            text = inline(node, compact=True)
            if text:
                return text.rpartition(".")[2]
            break
    return (dotted_name(signature) or anchor or signature.partition("(")[0].strip().rpartition(" ")[2]).rpartition(".")[2]


def _ancestors(node: Node, top: Node) -> Iterator[Node]:
    p = node.parent
    while p is not None and p is not top:
        yield p
        p = p.parent


def _signature_params(sig: Node) -> list[dict]:
    out = []
    for em in sig.walk():
        if em.tag != "em" or "sig-param" not in em.classes:
            continue
        text = inline(em, compact=True)
        head, colon, rest = text.partition(":")
        kind, equals, default = rest.partition("=") if colon else ("", *head.partition("=")[1:])
        name = head.partition("=")[0].strip().lstrip("*").strip()
        if name and name != "/":
            out.append({"name": name, "type": kind.strip(), "default": default.strip(), "description": ""})
    return out


def _described_params(dl: Node) -> Iterator[dict]:
    for label, dd in Renderer().pairs(dl):
        if label.lower() == "parameters":
            for item in parameter_items(dd):
                m = _PARAMETER.match(item.strip())
                if m:
                    yield {"name": m[1], "type": (m[2] or "").strip(), "default": "", "description": (m[3] or "").strip()}


def _merged_params(signed: list[dict], described: list[dict]) -> list[dict]:
    """Parameters by name: the signature's type stands, the description is the field's."""
    by_name = {p["name"]: p for p in signed}
    rows = list(signed)
    for p in described:
        mine = by_name.get(p["name"])
        if mine is None:
            by_name[p["name"]] = dict(p)
            rows.append(by_name[p["name"]])
        else:
            mine["type"] = mine["type"] or p["type"]
            mine["description"] = p["description"] or mine["description"]
    return [{"ord": i, **p} for i, p in enumerate(rows)]


def _note(node: Node, top: Node) -> dict | None:
    """A note, by class or by the words of a version sentence; none inside another note."""
    if any(a.classes & set(NOTE_CLASSES) for a in _ancestors(node, top)):
        return None
    kind = next((k for k in NOTE_CLASSES if k in node.classes), None)
    text, version = inline(node), ""
    changed, gone = _CHANGED.match(text), _DEPRECATED.match(text)
    if (changed or gone) and (kind is None or kind.startswith("version") or kind == "deprecated"):
        kind = kind or ("deprecated" if gone else f"version{changed[1].lower()}")
        *_, version, rest = (changed or gone).groups()
        version, text = version.strip(), rest.strip() or text
    return {"kind": kind, "version": version, "text": text} if kind and text else None


def _says_see_also(text: str) -> bool:
    return text.rstrip(":").lower() == "see also"


def _is_see_also(node: Node, after_label: bool) -> bool:
    title = next((c for c in node.elements if "admonition-title" in c.classes), None)
    return (
        after_label
        or "seealso" in node.classes
        or (node.tag == "p" and inline(node).lower().startswith("see also"))
        or ("admonition" in node.classes and title is not None and _says_see_also(inline(title, compact=True)))
    )


def _content(parent: Node, edge: str = "references") -> Iterator[tuple[Node, str]]:
    """Elements of a description outside other objects, with the edge type that a link in them has."""
    labelled = False
    for c in parent.elements:
        mine = edge
        if edge == "see_also" or _is_see_also(c, labelled and c.tag == "dd"):
            mine = "see_also"
        elif "warning" in c.classes:
            mine = "mentioned_in_warning"
        elif c.classes & {"note", "admonition", "versionadded", "versionchanged"}:
            mine = "mentioned_in_note"
        labelled = c.tag == "dt" and _says_see_also(inline(c, compact=True))
        if not is_object(c):
            yield c, mine
            yield from _content(c, mine)


def _link(a: Node, url: str, edge: str) -> dict | None:
    """A link to a place in a page."""
    if a.tag != "a" or "href" not in a.attrs or "headerlink" in a.classes:
        return None
    try:
        page, anchor = urldefrag(urljoin(url, a.attrs["href"]))
        target = canonical(page)
    except ValueError:
        return None
    if not anchor.strip():
        return None
    around = inline(a.parent) if a.parent is not None else ""
    name = inline(a, compact=True)
    return {"edge_type": edge, "source_kind": "xref", "target_url": target, "target_anchor": anchor.strip(), "target_name": name, "snippet": (around or name)[:300], "confidence": 1.0}


def _distinct(links: list[dict]) -> list[dict]:
    key = ("edge_type", "target_url", "target_anchor", "target_name", "snippet")
    return list({tuple(x[k] for k in key): x for x in reversed(links)}.values())[::-1]


def _entity(dl: Node, url: str, parent: str | None, number: int) -> dict | None:
    kind, sig = _object_kind(dl), dl.child("dt")
    if kind is None or sig is None:
        return None
    signature = inline(sig, compact=True)
    anchor = sig.attrs.get("id", "").strip() or None
    name = _simple_name(sig, signature, anchor)
    qualname = anchor or dotted_name(signature) or name
    bodies, summary, described, notes = [], "", [], []
    links = [x for a in sig.walk() if (x := _link(a, url, "references"))]
    for dd in (c for c in dl.elements if c.tag == "dd"):
        quiet = Renderer(objects=False)
        body = "\n\n".join(b for c in dd.children for b in ([normal(c)] if isinstance(c, str) else [] if is_object(c) else [quiet.fields(c)] if is_field_list(c) else quiet.blocks(c)) if b.strip())
        bodies.append(body)
        lead = next((t for c in dd.elements if c.tag == "p" and (t := inline(c))), "")
        summary = summary or lead or next((r.strip() for r in body.splitlines() if r.strip()), "")
        for node, edge in _content(dd):
            if is_field_list(node):
                described += _described_params(node)
            if node.tag in ("div", "p") and (note := _note(node, dd)):
                notes.append(note)
            if (x := _link(node, url, edge)) is not None:
                links.append(x)
    return {
        "local_id": anchor or f"{kind}:{qualname}:{number}", "parent_local_id": parent, "anchor": anchor, "kind": kind, "name": name, "qualname": qualname,
        "signature": signature, "summary": summary, "body_text": "\n\n".join(b for b in bodies if b), "line_start": None, "line_end": None,
        "params": _merged_params(_signature_params(sig), described), "notes": [{"ord": i, **n} for i, n in enumerate(notes)], "xrefs": _distinct(links),
    }


def entities(main: Node, url: str, body: str) -> list[dict]:
    """Classes and methods in document order, with parents and body lines."""
    out: list[dict] = []
    stack: list[tuple[Node, str | None]] = [(c, None) for c in main.elements[::-1]]
    while stack:
        node, parent = stack.pop()
        below = node.elements
        if is_object(node):
            found = _entity(node, url, parent, len(out))
            if found is not None:
                out.append(found)
                parent = found["local_id"]
            below = [g for c in node.elements if c.tag == "dd" for g in c.elements]
        stack.extend((c, parent) for c in below[::-1])
    _place(out, body)
    return out


def _place(found: list[dict], body: str) -> None:
    """Give entities their line: the next one, for equal signatures, that holds the signature or the name."""
    rows = [r.strip() for r in body.splitlines()]
    after: dict[str, int] = {}
    for e in found:
        wanted = [w for w in (e["signature"].strip(), e["name"].strip()) if w]
        if not wanted:
            continue
        key = wanted[0].lower()
        at = next((i for i in range(after.get(key, 0), len(rows)) if any(w in rows[i] for w in wanted)), None)
        if at is not None:
            after[key] = at + 1
            e["line_start"], e["line_end"] = at + 1, at + 1 + e["body_text"].count("\n")


# --- the table function ---------------------------------------------------------------------

_ENTITY = (
    "struct<local_id string, parent_local_id string, anchor string, kind string, name string, qualname string, signature string, summary string, body_text string, line_start int, line_end int, "
    "params array<struct<ord int, name string, type string, default string, description string>>, notes array<struct<ord int, kind string, version string, text string>>, "
    "xrefs array<struct<edge_type string, source_kind string, target_url string, target_anchor string, target_name string, snippet string, confidence double>>>"
)
SCHEMA = f"url string, title string, body string, toc_json string, entities array<{_ENTITY}>"


#: Pages that a Python worker holds read at a time.
_AT_ONCE = 128


def read_page(page: str, url: str) -> tuple[str, str, list[dict], list[dict]]:
    """(title, body, table of contents, entities) of one page."""
    root = tree(page)
    main = main_content(root)
    body = Renderer().text(main)
    found = title_of(root, url), body, contents(main, url), entities(main, url, body)
    # A tree that knows its parents would stay until Python happens to look for cycles.
    for node in list(root.walk()):
        node.parent = None
    return found


def parse(pages: DataFrame) -> DataFrame:
    """Pages (url, html) read: url, title, body, toc_json, entities."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # What is read of a page is many times its size as objects, so few pages go on at a time.
            for at in range(0, len(frame), _AT_ONCE):
                rows = []
                for url, page in zip(frame["url"][at : at + _AT_ONCE], frame["html"][at : at + _AT_ONCE]):
                    title, body, toc, found = read_page(page or "", url or "")
                    rows.append((url, title, body, json.dumps(toc, ensure_ascii=False), found))
                yield pd.DataFrame(rows, columns=["url", "title", "body", "toc_json", "entities"])

    workers(pages.sparkSession)
    return pages.select("url", "html").mapInPandas(run, SCHEMA)


def page_rows(parsed: DataFrame, source_base: str, fetched_at: int) -> DataFrame:
    """Rows of the pages table; the table of contents as a variant, since it nests without end."""
    return parsed.select("url", "title", "body", F.lit(source_base).alias("source_base"), F.lit(fetched_at).cast("long").alias("fetched_at"), F.parse_json("toc_json").alias("toc"))


def entity_rows(parsed: DataFrame, source_base: str) -> DataFrame:
    """Rows of the entity table, with arrays params, notes and xrefs; of equal ids on a page the first stays."""
    each = parsed.select("url", F.posexplode("entities").alias("no", "e"))
    own = F.when(F.coalesce("e.anchor", F.lit("")) != "", F.concat_ws("#", "url", "e.anchor")).otherwise(F.concat(F.col("url"), F.lit("#entity-"), F.col("no")))
    keyed = each.select("url", "no", own.alias("entity_id"), "e")
    parents = keyed.select("url", F.col("e.local_id").alias("parent_local_id"), F.col("entity_id").alias("parent_entity_id"))
    parents = parents.groupBy("url", "parent_local_id").agg(F.min("parent_entity_id").alias("parent_entity_id"))
    out = keyed.withColumn("parent_local_id", F.col("e.parent_local_id")).join(parents, ["url", "parent_local_id"], "left")
    first = out.groupBy("entity_id").agg(F.min_by(F.struct("url", "e", "parent_entity_id"), "no").alias("r"))
    plain = [F.col(f"r.e.{c}").alias(c) for c in ("anchor", "kind", "name", "qualname", "signature", "summary", "body_text", "line_start", "line_end", "params", "notes", "xrefs")]
    return first.select("entity_id", F.lit(source_base).alias("source_base"), F.col("r.url").alias("page_url"), F.col("r.parent_entity_id").alias("parent_entity_id"), *plain)


def child_tables(entities_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(params, notes) as tables of their own."""
    params = entities_.select("entity_id", F.explode("params").alias("p")).select("entity_id", "p.ord", "p.name", "p.type", F.col("p.default").alias("default_value"), "p.description")
    notes = entities_.select("entity_id", F.explode("notes").alias("n")).select("entity_id", "n.*")
    return params, notes


def toc_rows(parsed: DataFrame) -> DataFrame:
    """The table of contents flattened: url, path, level, id, title, summary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, toc in zip(frame["url"], frame["toc_json"]):
                stack = [(str(i), x) for i, x in enumerate(json.loads(toc))][::-1]
                while stack:
                    path, x = stack.pop()
                    rows.append((url, path, x["level"], x["id"], x["title"], x["summary"]))
                    stack.extend((f"{path}.{i}", c) for i, c in reversed(list(enumerate(x["children"]))))
            yield pd.DataFrame(rows, columns=["url", "path", "level", "id", "title", "summary"])

    return parsed.select("url", "toc_json").mapInPandas(run, "url string, path string, level int, id string, title string, summary string")
