"""From the markup of one page to its text blocks, each with the path of elements it stands in."""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass

# Element roles of HTML, by name.
RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol optgroup option p "
    "pre search section summary table tbody td template tfoot th thead tr ul".split()
)
VOID_BREAKS = frozenset({"hr"})
CHROME = frozenset("nav footer aside head noscript template dialog menu search option optgroup".split())
# Parts of a line that are no text of it; what a control says belongs to a line only with other text beside it.
GONE = "svg|canvas|select|object|datalist"
CONTROLS = frozenset({"button", "label"})
# Elements that stand inside a form only when the form is wrapped around a whole page.
FRAMES = frozenset("article main nav header footer".split())
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words of class and id names that mark what is not the article.
MARKED = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent gdpr "
    "comment comments commentlist disqus respond replies footer sidebar aside widget widgets nav navbar navigation menu "
    "notice notification alert popup modal overlay newsletter subscribe subscription signup login promo promotion promoted "
    "sponsor sponsored related recommended share sharing social pager pagination search skip toolbar masthead".split()
)
MARKED_OUTSIDE = frozenset({"header", "topbar"})
# Words that only say where a marked part is or how it is built; a name with any other word says something else.
PLAIN = frozenset(
    "site page post entry main primary secondary global top bottom left right upper lower side sticky fixed mobile desktop area "
    "bar block box btn button buttons col column container content form group holder icon icons inner item items layer link "
    "links list outer panel row section slot unit wrap wrapper".split()
)
COMMENTS = frozenset({"comment", "comments"})
# Kinds of adverts and comments are named by words before or after these: google-ad, comment-thread.
ADS = frozenset("ad ads advert adverts advertisement advertisements".split())
NEGATED = frozenset("no not non has have with without hide".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<gone>{GONE})\b[^>]*(?<!/)>.*?</(?P=gone)\s*>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    # a quote that is never closed: the tag ends where it seems to
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/<>]*)(?P<rest2>[^<>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^<>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(
    r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![\w-])",
    re.IGNORECASE,
)
WORD = re.compile(r"[a-z0-9]+")
NUMBER = re.compile(r"\d+")


@dataclass(slots=True)
class Open:
    tag: str
    path: str
    chrome: bool
    main: bool
    form: int


@dataclass(slots=True)
class Block:
    path: str
    text: str
    linked: int
    chrome: bool
    main: bool
    form: int
    control: bool

    @property
    def heading(self) -> bool:
        return self.path.rsplit(">", 1)[-1].split(".")[0] in HEADINGS


def _named(names: str, marked: frozenset[str]) -> bool:
    """Whether one of the names, read as a whole, is a marked word or one with words of place and build only, or a kind of advert
    or reader comment."""
    for name in names.split():
        words = [w.rstrip("0123456789") for w in WORD.findall(name) if not w[0].isdigit()]
        if not words or not NEGATED.isdisjoint(words):
            continue
        if not COMMENTS.isdisjoint(words) or words[-1] in ADS:
            return True
        if not marked.isdisjoint(words) and all(w in marked or w in PLAIN for w in words):
            return True
    return False


def _purpose(tag: str, classes: str, identity: str, main: bool) -> bool:
    """Whether class and id say that an element is not the article; the frame of a page and of its article is never judged."""
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":  # HTML marks up each comment as an article of its own
        return not COMMENTS.isdisjoint(classes.split())
    if tag in HEADINGS or (main and tag == "section"):
        identity = ""  # anchors named after what the text is about
    return _named(f"{classes} {identity}", MARKED if main else MARKED | MARKED_OUTSIDE)


def _opened(tag: str, rest: str, parent: Open, form: int) -> Open:
    main = parent.main or tag in ("article", "main")
    chrome = parent.chrome or tag in CHROME or (tag == "header" and not main)
    label = tag
    if rest and not rest.isspace():
        found = {}
        for m in ATTRIBUTE.finditer(rest):
            found.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
        classes, identity = found.get("class", "").lower(), found.get("id", "").lower()
        names = f"{classes} {identity}"
        label += "." + ".".join(sorted(NUMBER.sub("N", names).split()))
        chrome = (
            chrome
            or _purpose(tag, classes, identity, main)
            or found.get("role", "").lower() in ROLES
            or "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
            or re.search(r"display\s*:\s*none", found.get("style", "").lower()) is not None
        )
    return Open(tag, f"{parent.path}>{label}", chrome, main, form)


def _settled(blocks: list[Block], wrappers: set[int]) -> None:
    """Forms and controls are chrome, but for a form around the page or most of its text."""
    visible = [b for b in blocks if not b.chrome and not b.control]
    total = sum(len(b.text) for b in visible)
    held: dict[int, int] = {}
    for b in visible:
        held[b.form] = held.get(b.form, 0) + len(b.text)
    frames = {form for form, size in held.items() if form and form not in wrappers and 2 * size <= total}
    for b in blocks:
        b.chrome = b.chrome or b.control or b.form in frames


def parse(html: str) -> tuple[list[Block], list[str | int]]:
    """All text blocks in page order, chrome included; and the page as a sequence of element paths and numbers of blocks."""
    root = Open("", "", False, False, 0)
    stack = [root]
    blocks: list[Block] = []
    events: list[str | int] = []
    pieces: list[str] = []
    linked = 0
    in_link = False
    control: str | None = None
    spoken = False  # something but controls in the block
    forms = 0
    wrappers: set[int] = set()

    def flush() -> None:
        nonlocal linked, spoken
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            if text:
                top = stack[-1]
                events.append(len(blocks))
                blocks.append(Block(top.path, text, min(linked, len(text)), top.chrome, top.main, top.form, not spoken))
            pieces.clear()
        linked, spoken = 0, False

    def take(text: str) -> None:
        nonlocal linked, spoken
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text)
            if control is None and not text.isspace():
                spoken = True

    done = 0
    for m in MARKUP.finditer(html):
        take(html[done : m.start()])
        done = m.end()
        tag, end, rest = (m["tag"], m["end"], m["rest"]) if m["tag"] else (m["tag2"], m["end2"], m["rest2"])
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "a":
                in_link = not end
            elif tag in CONTROLS:
                control = None if end else tag
            elif tag == "br" or tag in VOID_BREAKS:
                take(" ")
                if tag in VOID_BREAKS:
                    flush()
            continue
        flush()
        control = None  # a control does not reach beyond its block
        if end:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == tag:
                    del stack[at:]
                    break
            continue
        if stack[-1].tag == "p":
            stack.pop()
        if tag in ENDED_BY:
            ended, within = ENDED_BY[tag]
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in within:
                    break
                if stack[at].tag in ended:
                    del stack[at:]
                    break
        form = stack[-1].form
        if tag == "form" and not form:
            forms += 1
            form = forms
        if tag in FRAMES and form:
            wrappers.add(form)
        new = _opened(tag, rest, stack[-1], form)
        events.append(new.path)
        stack.append(new)
    take(html[done:])
    flush()
    _settled(blocks, wrappers)
    return blocks, events
