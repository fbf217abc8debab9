"""A small HTML tree: block elements as nodes in document order, and the text runs they own."""

import re
from html import unescape

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
#: Elements whose content is no markup (fixed values).
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math object select".split())
_AFTER = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
#: Elements that run with the text around them (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q ruby rb rp rt s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes an open element of these names, unless one of the second is nearer (fixed values).
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
#: A paragraph ends at the start of any other block; these hold paragraphs of their own.
_HOLDS = frozenset("table td th button".split())


class Tree:
    """tag, attrs, parent, depth, end by node in document order (node 0 is the document; node i's subtree is i to end[i]).

    runs: (node, text with decoded references, in a link) in document order; a run that begins a block starts with a space.
    """

    __slots__ = ("tag", "attrs", "parent", "depth", "end", "runs")

    def __init__(self, html: str):
        tag, attrs, parent, depth, end = ["#"], [""], [-1], [0], [0]
        runs, stack, names = [], [0], ["#"]
        at, broken, link = 0, True, -1
        find = _TOKEN.search
        n = len(html)

        def close_to(level: int):
            nonlocal link
            while len(stack) > level:
                node = stack.pop()
                names.pop()
                end[node] = len(tag)
                if node == link:
                    link = -1

        while at < n:
            m = find(html, at)
            stop = m.start() if m else n
            if stop > at:
                text = unescape(html[at:stop]) if "&" in html[at:stop] else html[at:stop]
                runs.append((stack[-1], " " + text if broken else text, link >= 0))
                broken = False
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:
                if name == "a":
                    link = -1
                elif name not in INLINE:
                    broken = True
                    if name in names:
                        level = len(names) - 1 - names[::-1].index(name)
                        close_to(level)
                continue
            if name in RAW:
                after = _AFTER[name].search(html, at)
                if not (m[3] or m[6] or "").endswith("/") or name not in ("svg", "math"):
                    at = after.end() if after else n
                continue
            if name == "a":
                link = stack[-1]
                continue
            if name in INLINE:
                continue
            broken = True
            if name in VOID:
                if name not in ("input", "embed"):
                    continue
            if "p" in names:
                level = len(names) - 1 - names[::-1].index("p")
                if not any(x in _HOLDS for x in names[level + 1 :]):
                    close_to(level)
            if name in CLOSES:
                shut, until = CLOSES[name]
                for level in range(len(names) - 1, 0, -1):
                    if names[level] in until:
                        break
                    if names[level] in shut:
                        close_to(level)
                        break
            node = len(tag)
            tag.append(name)
            attrs.append(m[3] or m[6] or "")
            parent.append(stack[-1])
            depth.append(len(stack))
            end.append(node + 1)
            if name not in VOID:
                stack.append(node)
                names.append(name)
        close_to(0)
        self.tag, self.attrs, self.parent, self.depth, self.end, self.runs = tag, attrs, parent, depth, end, runs

    def text(self, keep=None) -> str:
        """Text of the nodes whose entry in keep is true: blocks in order, white space as one space."""
        return " ".join("".join(t if keep is None or keep[node] else " " for node, t, _ in self.runs).split())
