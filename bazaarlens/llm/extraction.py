"""Main text of web pages by wrapper induction over the pages of one host.

The block trees of a host's pages are aligned by simple tree matching: its most common layouts
merge into one template, and every page's nodes take the slot of the template's node they match,
or one named by their labels below it. A text that most pages have in the same slot is constant,
so part of the template; slots that vary are content, but for those that are menus, headers,
footers, sidebars, notices, adverts, forms or comments by their elements and names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm import dom
from bazaarlens.llm.common import column, slices
from bazaarlens.llm.url_filter import host_of
from bazaarlens.session import written

BLOCK = "struct<node:int,hash:long,region:int,text:string>"


def main_text(pages: DataFrame, page: str = "html", url: str = "url", layouts: int = 16, pages_at_least: int = 3, share: float = 0.6, menu_share: float = 0.5) -> DataFrame:
    """All columns of ``pages`` but ``page``, with ``text``: the main text, empty if there is none.

    A template comes from a host's ``layouts`` most common layouts, counted over all its pages.
    Whether a text is constant is counted over all pages, too: it is in its slot on at least
    ``pages_at_least`` pages and ``share`` of them (of the host's pages for slots in an article or
    main element, of the pages with that slot elsewhere). Pages count by their longest block, so
    that copies of one article, which agree in all texts, are one page and no template. Outside of
    articles a slot is a menu if more than ``menu_share`` of its characters are links.

    Of the content left, the page's text is what lies in its article elements; if nothing does, in
    main elements; then in containers named like content; then everywhere. A header inside of an
    article keeps its headings only. Blocks are joined by one space, white space in a block is one
    space, and inline markup joins without space. Null and empty pages give an empty text, null
    urls and urls without host form one host of their own. A page whose host has no other page has
    no constants. Repeated rows stay; columns of any name are carried along; a column ``text`` or
    ``TEXT`` is replaced.
    """
    others = [c for c in pages.columns if c != page and c.lower() != "text"]
    plain = pages.select(host_of(column(url)).alias("host"), column(page).alias("page"))
    seen = written(plain.mapInArrow(_facts, FACTS), "page-facts")
    verdicts = written(_verdicts(seen, layouts, pages_at_least, share, menu_share), "verdicts")

    carried = pages.select(
        host_of(column(url)).alias("host"), column(page).alias("page"),
        F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("_")).alias("rest"),
    )
    kind = carried.schema["rest"].dataType.simpleString()
    read = carried.mapInArrow(_read, f"rest {kind}, host string, shape long, blocks array<{BLOCK}>")
    judged = read.join(verdicts, ["host", "shape"], "left").select("rest", _joined().alias("text"))
    return judged.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(others)], "text")


def _joined() -> Column:
    """The blocks that stay, of the best region that any of them lies in."""
    fixed, menus = F.coalesce("fixed", F.array()), F.coalesce("menus", F.array())
    varying = F.filter(
        "blocks",
        lambda b: ~F.array_contains(fixed, F.struct(b["node"].alias("node"), b["hash"].alias("hash")))
        & ~F.array_contains(menus, b["node"]),
    )
    best = F.array_min(F.transform(varying, lambda b: b["region"]))
    texts = F.transform(F.filter(varying, lambda b: b["region"] == best), lambda b: b["text"])
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


# --- what is read off a page -------------------------------------------------------------------

FACTS = "host string, layout string, shape long, page long, nodes array<int>, hashes array<long>, sizes array<int>, linked array<int>, regions array<int>"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _page(page: str | None) -> tuple[str, list[dom.Block]]:
    root, blocks = dom.parse(page or "")
    folded = dom.fold(root)
    dom.number(folded)
    return dom.written_out(folded), blocks


def _facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its layout and the blocks that are not dropped by name, as numbers."""
    schema = pa.schema(
        [
            ("host", pa.string()), ("layout", pa.string()), ("shape", pa.int64()), ("page", pa.int64()),
            ("nodes", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
            ("linked", pa.list_(pa.int32())), ("regions", pa.list_(pa.int32())),
        ]
    )
    for batch in slices(batches, "page"):
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist()):
            layout, blocks = _page(page)
            blocks = [b for b in blocks if not dom.dropped(b.node)]
            longest = max((b.text for b in blocks), key=lambda t: (len(t), t), default="")
            rows.append(
                (
                    host, layout, _hash(layout), _hash(longest), [b.node.at for b in blocks],
                    [_hash(b.text) for b in blocks], [len(b.text) for b in blocks],
                    [b.linked for b in blocks], [b.node.region for b in blocks],
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its blocks with their texts."""
    block = [("node", pa.int32()), ("hash", pa.int64()), ("region", pa.int32()), ("text", pa.string())]
    kind = pa.list_(pa.struct(block))
    for batch in slices(batches, "page"):
        shapes, out = [], []
        for page in batch.column("page").to_pylist():
            layout, blocks = _page(page)
            shapes.append(_hash(layout))
            blocks = [b for b in blocks if not dom.dropped(b.node)]
            out.append([(b.node.at, _hash(b.text), b.node.region, b.text) for b in blocks])
        yield pa.RecordBatch.from_arrays(
            [batch.column("rest"), batch.column("host"), pa.array(shapes, pa.int64()), pa.array(out, kind)],
            names=["rest", "host", "shape", "blocks"],
        )


# --- templates and what is constant in them ----------------------------------------------------


def templates(shapes: DataFrame, layouts: int) -> DataFrame:
    """Per host its most common layouts, merged.

    Taken in two steps, first among those with the same remainder of the hash, so that no host's
    layouts all meet in one task.
    """
    order = [F.desc("pages"), F.asc("layout")]
    for keys in (["host", F.pmod("shape", F.lit(64))], ["host"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        shapes = shapes.withColumn("place", place).where(F.col("place") <= layouts)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["place"].to_pylist(), table["layout"].to_pylist()))
        tree = dom.read_in(rows[0][1])
        for _, layout in rows[1:]:
            tree = dom.merged(tree, dom.read_in(layout))
        return pa.table({"host": table["host"][:1], "template": [dom.written_out(tree)]})

    return shapes.groupBy("host").applyInArrow(merge, "host string, template string")


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [
            [_hash(s) for s in dom.aligned(dom.read_in(a), dom.read_in(b))]
            for a, b in zip(batch.column("layout").to_pylist(), batch.column("template").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("shape"), pa.array(slots, pa.list_(pa.int64()))],
            names=["host", "shape", "slots"],
        )


def _verdicts(seen: DataFrame, layouts: int, pages_at_least: int, share: float, menu_share: float) -> DataFrame:
    """Per host and shape: the (node, hash) pairs that are constant, and the nodes that are menus."""
    shapes = seen.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.min("layout").alias("layout"))
    shapes = written(shapes, "shapes")
    matched = shapes.select("host", "shape", "layout").join(templates(shapes, layouts), "host")
    matched = written(matched.mapInArrow(_align, "host string, shape long, slots array<long>"), "aligned")

    blocks = seen.select(
        "host", "shape", "page", F.explode(F.arrays_zip("nodes", "hashes", "sizes", "linked", "regions")).alias("b")
    )
    # One row per text, page and node first: copies and repeats go before the join.
    blocks = blocks.groupBy("host", "shape", "page", F.col("b.nodes").alias("node"), F.col("b.hashes").alias("hash")).agg(
        F.sum("b.sizes").alias("size"), F.sum("b.linked").alias("linked"), F.min("b.regions").alias("region")
    )
    nodes = matched.select("host", "shape", F.posexplode("slots").alias("node", "slot"))
    placed = written(blocks.join(nodes, ["host", "shape", "node"]), "placed")

    inside = F.col("region") <= dom.IN_MAIN
    texts = placed.groupBy("host", "slot", "hash", "page").agg(F.min("region").alias("region"))
    texts = texts.groupBy("host", "slot", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("region"))
    texts = texts.where(F.col("n") >= pages_at_least)
    in_slot = placed.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("in_slot"))
    in_host = seen.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("in_host"))
    constant = texts.join(in_slot, ["host", "slot"]).join(in_host, "host")
    constant = constant.where(F.col("n") >= share * F.when(inside, F.col("in_host")).otherwise(F.col("in_slot")))

    sums = placed.groupBy("host", "slot").agg(
        F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.min("region").alias("region")
    )
    menu = sums.where((F.col("region") > dom.IN_ARTICLE) & (F.col("linked") > menu_share * F.col("size")))

    fixed = nodes.join(constant.select("host", "slot", "hash"), ["host", "slot"])
    fixed = fixed.groupBy("host", "shape").agg(F.collect_list(F.struct("node", "hash")).alias("fixed"))
    menus = nodes.join(menu.select("host", "slot"), ["host", "slot"])
    menus = menus.groupBy("host", "shape").agg(F.collect_list("node").alias("menus"))
    return fixed.join(menus, ["host", "shape"], "full")
