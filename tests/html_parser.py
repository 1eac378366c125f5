"""The standard library's parser reading the same fields, to compare the column expressions with."""

from html.parser import HTMLParser

from vacancyledger.sources.html_fields import CONTAINERS, VOID, Selector


def hit(selector: Selector, tag: str, attrs: dict[str, str]) -> bool:
    if selector.tag and tag != selector.tag:
        return False
    if selector.css_id and attrs.get("id") != selector.css_id:
        return False
    if selector.css_class and selector.css_class not in attrs.get("class", "").split():
        return False
    if selector.attr:
        if selector.attr not in attrs:
            return False
        if selector.equals and attrs[selector.attr] != selector.equals:
            return False
        if selector.contains and selector.contains not in attrs[selector.attr]:
            return False
    return True


class Fields(HTMLParser):
    """Collects text and source of the elements that match a selector."""

    def __init__(self, source: str, fields: dict[str, tuple[Selector, ...]]) -> None:
        super().__init__(convert_charrefs=True)
        self.source, self.fields = source, fields
        self.found: dict[str, list[dict]] = {name: [] for name in fields}
        self.stack: list[tuple[str, list[dict]]] = []
        self.line_starts = [0]
        for i, char in enumerate(source):
            if char == "\n":
                self.line_starts.append(i + 1)
        self.feed(source)
        self.close()
        while self.stack:
            self._pop(len(source))

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        opened = []
        for name, selectors in self.fields.items():
            if any(hit(s, tag, given) for s in selectors):
                element = {"text": [], "attrs": given, "start": self._offset()}
                element["end"] = element["start"] + len(self.get_starttag_text() or "")
                self.found[name].append(element)
                opened.append(element)
        if tag not in VOID:
            self.stack.append((tag, opened))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop(self._offset())

    def handle_endtag(self, tag):
        if not any(open_tag == tag for open_tag, _ in self.stack):
            return
        close_at = self.source.find(">", self._offset()) + 1
        while True:
            if self._pop(close_at) == tag:
                return

    def _pop(self, end: int) -> str:
        tag, opened = self.stack.pop()
        for element in opened:
            element["end"] = max(element["end"], end)
        return tag

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style", "template"):
            return
        piece = data.strip()
        if piece:
            for _, opened in self.stack:
                for element in opened:
                    element["text"].append(piece)


class Entries(Fields):
    """Links with the fields of the nearest list item, row, article or block around them."""

    def __init__(self, source: str, fields: dict[str, tuple[Selector, ...]]) -> None:
        self.containers: list[tuple[str, dict]] = []
        self.links: list[tuple[dict, dict | None]] = []
        super().__init__(source, {**fields, "link": (Selector("a", attr="href"),)})

    def handle_starttag(self, tag, attrs):
        counts = {name: len(hits) for name, hits in self.found.items()}
        super().handle_starttag(tag, attrs)
        for name, hits in self.found.items():
            if len(hits) == counts[name]:
                continue
            if name == "link":
                self.links.append((hits[-1], self.containers[-1][1] if self.containers else None))
            for _, held in self.containers:
                held.setdefault(name, hits[-1])
        if tag in CONTAINERS:
            self.containers.append((tag, {}))

    def _pop(self, end: int) -> str:
        tag = super()._pop(end)
        if tag in CONTAINERS and self.containers:
            self.containers.pop()
        return tag
