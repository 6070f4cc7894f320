"""HTML and Markdown as rows of blocks, by Arrow-batched parsers; malformed input never fails a batch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "id long, ord long, kind string, level int, text string, error string"
#: Tags that end the block before them.
BLOCK_TAGS = frozenset("p div section article header footer main nav aside ul ol table tr body html title".split())
SKIPPED = frozenset({"script", "style"})


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.kind, self.level, self.text, self.skip, self.cells = "paragraph", 0, [], 0, None

    def flush(self) -> None:
        text = "".join(self.text)
        text = text.strip("\n") if self.kind == "code" else " ".join(text.split())
        if text:
            self.blocks.append((self.kind, self.level, text))
        self.text, self.kind, self.level = [], "paragraph", 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag in ("li", "pre", "blockquote"):
            self.flush()
            self.kind = {"li": "list_item", "pre": "code", "blockquote": "quote"}[tag]
        elif tag == "hr":
            self.flush()
            self.blocks.append(("rule", 0, ""))
        elif tag == "br" or tag in BLOCK_TAGS:
            self.flush()
            if tag == "tr":
                self.kind = "table_row"
        elif tag in ("td", "th") and self.text:
            self.text.append(" | ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCK_TAGS or tag in ("li", "pre", "blockquote") or re.fullmatch("h[1-6]", tag):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def html_blocks(html: str) -> list[tuple[str, int, str]]:
    parser = _Html()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def markdown_blocks(text: str) -> list[tuple[str, int, str]]:
    out, para, fence = [], [], None

    def flush() -> None:
        if para:
            out.append(("paragraph", 0, " ".join(para)))
            para.clear()

    for line in text.split("\n"):
        bare = line.strip()
        if fence is not None:
            if bare.startswith("```"):
                out.append(("code", 0, "\n".join(fence)))
                fence = None
            else:
                fence.append(line)
        elif bare.startswith("```"):
            flush()
            fence = []
        elif not bare:
            flush()
        elif re.fullmatch(r"(?:(?:- *){3,}|(?:\* *){3,}|(?:_ *){3,})", bare):
            flush()
            out.append(("rule", 0, ""))
        elif m := re.match(r"(#{1,6}) +(.*?)#*$", bare):
            flush()
            out.append(("heading", len(m[1]), m[2].strip()))
        elif m := re.match(r"(?:[-*+]|\d+[.)]) +(.*)", bare):
            flush()
            out.append(("list_item", (len(line) - len(line.lstrip())) // 2, m[1]))
        elif bare.startswith(">"):
            flush()
            out.append(("quote", 0, bare.lstrip("> ").strip()))
        elif bare.startswith("|"):
            flush()
            cells = [c.strip() for c in re.split(r"(?<!\\)\|", bare.strip("|"))]
            if not all(re.fullmatch(":?-+:?", c) for c in cells):
                out.append(("table_row", 0, " | ".join(c.replace("\\|", "|") for c in cells)))
        else:
            para.append(bare)
    flush()
    if fence is not None:
        out.append(("code", 0, "\n".join(fence)))
    return out


def _blocks(kind: str):
    parse = {"html": html_blocks, "markdown": markdown_blocks}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(key, i, *b, None) for i, b in enumerate(parse(text or ""))]
                except Exception as e:  # a file's failure is its own row
                    rows.append((key, 0, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def to_blocks(rows: DataFrame, key: str, body: str, kind: str) -> DataFrame:
    """(key, ord, kind, level, text, error) of the 'html' or 'markdown' in body."""
    return rows.selectExpr(f"cast({key} as long) as id", f"cast({body} as string) as body").mapInArrow(_blocks(kind), SCHEMA).withColumnRenamed("id", key)
