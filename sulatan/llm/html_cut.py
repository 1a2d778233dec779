"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: element names, and words of class and id attributes
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
#: of these, a missing end tag hides the rest of a page, as in a browser
TO_END = frozenset(("script", "style"))
#: these end at a block that cannot stand in them
ENDED = frozenset(("svg", "math", "select"))
AWAY = frozenset("nav footer aside form menu dialog button label option".split())
BAD = re.compile(r"(?:^|[^a-z])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-bar|rail|widget|nav|navbar|navigation|menu|breadcrumb\w*|pager|pagination|footer|header|masthead|topbar|toolbar|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|more-?links|comment\w*|disqus|replies|respond|reader\w*|meta|byline|tags|legal|copyright|disclaimer)(?![a-z])", re.I)
GOOD = re.compile(r"(?:^|[^a-z])(?:article\w*|content|main|post|entry|story|body|text)(?![a-z])", re.I)
#: names that tell of another part, or of the title of the content
OTHERS = re.compile(r"(?:has|with|no|without|hide)[-_]|(?:entry|post|article|story|content)[-_]+header$", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BREAKS = "|".join(sorted(BLOCKS - {"hr"}))
SPACE = re.compile(r"\s+")
COMMENTS = re.compile(r"(?:^|[^a-z])(?:comment\w*|disqus|replies|reply|respond|reader\w*)(?![a-z])", re.I)
#: an article of this name is a comment
ONE_COMMENT = re.compile(r"(?:[a-z]+-)?(?:comment|reply)s?(?:-?item|-?body|-?\d+)?", re.I)
#: containers that can be the main part of a page without an article
WRAPPERS = frozenset("body center div dl html section table tbody td tr".split())
#: an end tag of these closes nothing outside the article or main element it stands in
SCOPED, SCOPES = frozenset("p li div span".split()), frozenset("article main body".split())
#: smoothness of neighbours in page order, and of siblings in one container
NEXT, SIBLING = 0.4, 0.6


class Part:
    """An open container: why it may be boilerplate, and what it holds."""

    __slots__ = ("up", "name", "never", "bad", "header", "remarks", "article", "good", "clean", "held", "standing")

    def __init__(self, up: "Part | None", name: str = "", attributes: str = "") -> None:
        found = {k.lower(): a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))}
        hints = [t for k in ("class", "id", "role") for t in found.get(k, "").split() if not OTHERS.match(t)]
        if any(GOOD.fullmatch(t) for t in hints):  # "text search-tips" is a text: only whole names count against it
            hints = [t for t in hints if BAD.fullmatch(t) or not BAD.search(t)]
        page = name in ("html", "body")
        hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(NO_DISPLAY.search(found.get("style", "")))
        whole = name in ("article", "main")
        named = bool(BAD.search(" ".join(hints)))
        self.up, self.name, self.header = up, name, name == "header"
        #: hidden, or an element that is never content
        self.never = (hidden and not page) or name in AWAY - {"form"}
        comment = name == "article" and any(ONE_COMMENT.fullmatch(t) for t in hints)
        self.bad = name == "form" or comment or (named and not page and not whole)
        self.remarks = comment or (not whole and not page and bool(COMMENTS.search(" ".join(hints))))
        self.article = whole and not comment
        self.good = name in ("div", "section") and bool(GOOD.search(" ".join(found.get(k, "") for k in ("class", "id", "role"))))
        self.clean, self.standing = 0, (False, False, False)
        #: main elements, articles without a bad name, containers named as content, paragraphs inside
        self.held = [int(name == "main"), int(name == "article" and not named), int(self.good and not named), 0]

    def settle(self, page: list[int], chosen: bool = False) -> None:
        """``standing``: boilerplate by its containers, inside the main part, inside an article or main element.

        A bad name does not count on what holds a main element or all of the
        ``page``'s articles, or else all its parts named as content, or else
        all its paragraphs, two at least; whatever the shares of the text.
        Reader comments are never taken for the page, but for a main element.
        """
        away, inside, proper = self.up.standing if self.up else (False, False, False)
        kinds = [k for k in (1, 2, 3) if page[k] > (k == 3)][:1]
        whole = self.held[0] > 0 or (not self.remarks and any(self.held[k] == page[k] for k in kinds))
        away |= self.never or ((self.bad or (self.header and not inside)) and not whole)
        self.standing = away, inside or self.article or chosen or (not away and self.good), proper or self.article


class Block:
    """A run of text between block tags, with what the classifier looks at."""

    __slots__ = ("parts", "tag", "box", "part", "linked", "text")

    def __init__(self, tag: str, box: int, part: Part) -> None:
        self.parts: list[str] = []
        self.tag, self.box, self.part, self.linked, self.text = tag, box, part, 0, ""


@lru_cache(maxsize=64)
def _end(name: str, at_block: bool) -> re.Pattern:
    return re.compile(rf"</{name}[\s/>]" + (rf"|<(?:{BREAKS})[\s/>]" if at_block else ""), re.I)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; markup, scripts, styles and hidden parts give none.

    Containers nest by their tags; an end tag closes the nearest open
    container of its name, missing end tags are tolerated: a page goes on
    after a start tag whose end tag is missing (but for scripts and styles).
    """
    out: list[Block] = []
    parts = [Part(None)]
    stack: list[tuple[str, int, Part]] = [("", 0, parts[0])]  # name, box, container
    opened: list[Counter] = [Counter()]  # names open in each article or main element
    every: Counter = Counter()
    endless: set[str] = set()
    boxes, links, at, pattern, now = 1, 0, 0, TAG, None

    def leave() -> str:
        name = stack.pop()[0]
        every[name] -= 1
        if name in SCOPES:
            opened.pop()
        opened[-1][name] -= 1
        return name

    def add(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        if now is None:
            if raw.isspace():
                return
            now = Block(*stack[-1])
            out.append(now)
        now.parts.append(raw)
        if links:
            now.linked += len(raw)

    while True:
        spot = page.find("<", at)
        if spot < 0:
            add(page[at:])
            break
        m = pattern.match(page, spot)
        if m is None and pattern is TAG and page[spot + 1 : spot + 2].isalpha():
            pattern = LOOSE  # an open quote: from here on quotes mean nothing
            m = pattern.match(page, spot)
        if m is None:
            add(page[at : spot + 1])
            at = spot + 1
            continue
        add(page[at:spot])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS or name in AWAY:
                now = None
                if (opened[-1] if name in SCOPED else every)[name] > 0:
                    while leave() != name:
                        pass
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = None if name in endless else _end(name, name in ENDED).search(page, at)
                if end is None:
                    endless.add(name)
                if end and page[end.start() + 1] != "/":
                    at = end.start()
                elif end or name in TO_END:
                    close = page.find(">", end.start()) if end else -1
                    at = close + 1 if close >= 0 else len(page)
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            links += 1
        elif name in BLOCKS or name in AWAY:
            now, links = None, 0
            if name in BLOCKS - {"html", "body"} and stack[-1][0] in HEADINGS | {"p"}:
                leave()
            if name == "li" and stack[-1][0] == "li":
                leave()
            if name == "hr" or m[3].endswith("/"):
                continue
            parts.append(Part(stack[-1][2], name, m[3]))
            box = stack[-1][1] if name in HEADINGS | {"p", "li", "dt", "dd", "td", "th", "tr", "tbody", "pre"} else boxes
            boxes += 1
            stack.append((name, box, parts[-1]))
            every[name] += 1
            opened[-1][name] += 1
            if name in SCOPES:
                opened.append(Counter())
    for b in out:
        b.text = SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
        b.part.held[3] += b.tag == "p" and bool(b.text)
    for part in reversed(parts):
        if part.up and not part.never:
            part.up.held = [x + y for x, y in zip(part.up.held, part.held[:1] if part.remarks else part.held)] + (part.up.held[1:] if part.remarks else [])
    for part in parts:
        part.settle(parts[0].held)
    if not any(inside and not away for away, inside, _ in (b.part.standing for b in out if b.text)):
        main = _main_part(parts, out)
        for part in parts:
            part.settle(parts[0].held, part is main)
    return [b for b in out if b.text]


def _main_part(parts: list[Part], found: list[Block]) -> Part:
    """The smallest container with most of the text, but for boilerplate and links, down from the page."""
    for b in found:
        if not b.part.standing[0]:
            b.part.clean += max(0, sum(map(len, b.parts)) - b.linked)
    largest: dict[int, Part] = {}
    for part in reversed(parts):
        if part.up:
            part.up.clean += part.clean
            best = largest.get(id(part.up))
            if part.name in WRAPPERS and (best is None or part.clean >= best.clean):
                largest[id(part.up)] = part
    main = parts[0]
    while (part := largest.get(id(main))) is not None and 2 * part.clean > main.clean:
        main = part
    return main


def leaning(b: Block) -> float:
    """Log-odds of content over boilerplate from a block alone; links count little inside an article."""
    away, inside, proper = b.part.standing
    words = b.text.count(" ") + 1
    linked = min(1.0, b.linked / max(1, sum(map(len, b.parts))))
    score = -1.2 + min(words, 40) / 12 - (0.5 if proper else 3.5) * linked
    score += 3.0 if inside else 0.0
    score -= 7.0 if away else 0.0
    score += 0.7 if b.tag in HEADINGS else 0.5 if b.tag in ("p", "blockquote", "pre") else -0.5 if b.tag in ("li", "td", "th") else 0.0
    return score + (0.4 if b.text[-1] in ".!?。" else 0.0)


def min_cut(lean: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (true: content) of least cost: the smaller terminal capacity of each node, plus the edges between labels.

    A node that leans further than its edges can pull is settled at once and
    then pulls its neighbours; augmenting flow settles the rest, component by
    component. Nodes that neither side reaches become boilerplate.
    """
    near: list[dict[int, float]] = [{} for _ in lean]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    lean, label = list(lean), [None] * len(lean)
    todo = deque(range(len(lean)))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(lean[i]) > sum(near[i].values()):
            label[i] = lean[i] > 0
            for j, w in near[i].items():
                lean[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    for i in range(len(lean)):
        if label[i] is None:
            part, seen = [i], {i}
            for k in part:
                new = [j for j in near[k] if j not in seen]
                seen.update(new)
                part += new
            for k, side in _flow(part, lean, near).items():
                label[k] = side
    return label


def _flow(part: list[int], lean: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Maximum flow by levels; what the source still reaches is content."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {k: dict(near[k]) for k in part} | {source: {}, sink: {}}
    for k in part:
        if lean[k] > 0:
            room[source][k], room[k][source] = lean[k], 0.0
        else:
            room[k][sink], room[sink][k] = -lean[k], 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            k = queue.popleft()
            for j, w in room[k].items():
                if w > 1e-12 and j not in level:
                    level[j] = level[k] + 1
                    queue.append(j)
        if sink not in level:
            return {k: k in level for k in part}
        left = {k: deque(v) for k, v in room.items()}
        path = [source]
        while path:
            k = path[-1]
            if k == sink:
                push = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= push
                    room[b][a] += push
                # go on from the first full edge
                path = path[: 1 + next(n for n, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= 1e-12)]
                continue
            while left[k] and not (room[k][left[k][0]] > 1e-12 and level.get(left[k][0]) == level[k] + 1):
                left[k].popleft()
            if left[k]:
                path.append(left[k][0])
            else:
                path.pop()
                if path:
                    left[path[-1]].popleft()


def main_text(page: str | None) -> str:
    """Blocks labelled content, one a line."""
    found = blocks(page or "")
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = NEXT
        if b.box in last:
            pair = (last[b.box], i)
            edges[pair] = edges.get(pair, 0.0) + SIBLING
        last[b.box] = i
    return "\n".join(b.text for b, keep in zip(found, min_cut([leaning(b) for b in found], edges)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row.

    A page's text blocks are the nodes of a graph. A block's log-odds from its
    tag, containers, length and links become its terminal capacity; neighbours
    in page order and siblings in one container are joined by smoothness
    edges; the minimum cut labels the blocks. Character references are
    decoded, white space inside a block becomes one space, and the content
    blocks are joined by one line break.

    Null and empty pages give an empty text; a null id or url stays null;
    repeated rows are extracted alike; extra columns are ignored; an empty
    table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
