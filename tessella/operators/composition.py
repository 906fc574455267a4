"""Quotes composed in variants: selected recommendations of packs, template components, rooms, totals. Every table is keyed by `quote`.

Which template components are added looks like a fold over packs, but it only asks who has a product
first: the components of a variant are reduced to one a product and those that a line uses are taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.money import half_up

VARIANTS = ["budget", "standard", "premium"]
# Names of rooms and notes.
ROOM, PACK, NO_AREA = "Hạng mục BOM", "Bộ cấu hình", "Chưa phân khu"
SAMPLE = 5


def _filled(*names: str, last: str = "") -> Column:
    """The first of the texts that is not empty."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(last))


def asked_first(rec: Column, place: Column) -> Column:
    """The order of recommendations: the one `asked` for, then by place."""
    return F.struct((rec != F.col("asked")).alias("other"), place.alias("place"))


def selected_recommendations(packs: DataFrame, recommendations: DataFrame, selections: DataFrame) -> DataFrame:
    """(quote, scope, pack_place, scope_label, and the recommendation's columns): the one the user selected, else the pack's own, else the first; an unknown id gives the first.

    packs: quote, scope, pack_place, scope_label, selected; recommendations: quote, scope, rec, place, title, vendor, tier, template
    (its label or null); selections: quote, scope, rec. Packs without recommendations are left out.
    """
    asked = packs.join(selections.select("quote", "scope", F.col("rec").alias("asked")), ["quote", "scope"], "left").withColumn("asked", _filled("asked", "selected"))
    best = recommendations.join(asked, ["quote", "scope"]).groupBy("quote", "scope").agg(F.min_by(F.struct("pack_place", "scope_label", "rec", "title", "vendor", "tier", "template"), asked_first(F.col("rec"), F.col("place"))).alias("s"))
    return best.select("quote", "scope", "s.*")


def selected_of(rows: DataFrame, recommendations: list[dict[str, str]]) -> DataFrame:
    """The same choice on rows that carry what their pack knows (asked, selected), without a join: the columns of the recommendations, given as expressions by name."""
    known, fields = rows.withColumn("asked", _filled("asked", "selected")), ("rec", "title", "vendor", "tier", "template")
    recs = [{name: F.expr(x) for name, x in r.items()} for r in recommendations]
    first = _least([F.struct(asked_first(r["rec"], r["place"]).alias("at"), F.struct(*(r[f].alias(f) for f in fields)).alias("r")) for r in recs])["r"]
    known = known.withColumn("s", F.when(F.col("quote").isNotNull() & F.col("scope").isNotNull(), first)).drop("asked", "selected")
    return known.select("*", *(F.col(f"s.{f}") for f in fields)).drop("s")


def _least(some: list[Column]) -> Column:
    """The least that is not null."""
    return F.least(*some) if len(some) > 1 else some[0]


def line_rooms(lines: DataFrame, selected: DataFrame, grouping: str = "scope") -> DataFrame:
    """Lines with their room, note and quantity (1 for none). lines: quote, line, place, scope, qty, name, model, sheet, row, area, section, label, category."""
    return placed_lines(lines.join(selected.select("quote", "scope", "title"), ["quote", "scope"], "left"), grouping)


def placed_lines(found: DataFrame, grouping: str = "scope", *keep: str) -> DataFrame:
    """`line_rooms` of lines that have their selected recommendation's title."""
    place = F.when(F.col("area") != NO_AREA, F.col("area"))
    room = {
        "pack": _filled("title", "label", "category", last=ROOM), "scope": _filled("label", "category", last=ROOM),
        "area": F.coalesce(F.nullif(place, F.lit("")), _filled("section", "category", last=ROOM)),
    }[grouping]
    part = lambda c, *text: F.when(_filled(c) != "", F.concat(F.lit(" · "), *text)).otherwise("")
    note = F.concat(_filled("name"), part("model", F.col("model")), part("sheet", F.col("sheet"), F.lit(" dòng "), F.coalesce(F.col("row").cast("string"), F.lit(""))), part("title", F.lit("PA: "), F.col("title")))
    qty = F.coalesce(F.nullif(F.col("qty").cast("double"), F.lit(0.0)), F.lit(1.0))
    return found.select("quote", "line", "place", "scope", qty.alias("qty"), room.alias("room"), F.trim(note).alias("note"), _filled("name", "model").alias("shown"), *keep)


def template_lines(selected: DataFrame, components: DataFrame, candidates: DataFrame, chosen: DataFrame, grouping: str = "scope") -> DataFrame:
    """(quote, variant, product, qty, room, note, place, shown): products of the selected templates' components, one line a product and variant.

    components: quote, scope, rec, component, label, required, auto, qty; candidates: quote, scope, rec, component, place, product, price,
    known products only; chosen: quote, variant, product of the lines. Required components that add themselves are in all
    variants, others that do in the premium one. The cheapest, the first or the dearest candidate is taken, of equals the
    first; of a product that several components ask for, the first pack's first component counts.
    """
    wanted = components.where("auto").join(selected.where("template is not null"), ["quote", "scope", "rec"])
    order = {"budget": F.struct(_price("price"), "place"), "standard": F.struct("place"), "premium": F.struct(-_price("price"), "place")}
    offered = candidates.groupBy("quote", "scope", "rec", "component").agg(*(F.min_by(F.struct("product"), order[v]).alias(v) for v in VARIANTS))
    return added_products(wanted.join(offered, ["quote", "scope", "rec", "component"]), chosen, grouping)


def _price(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def offered_products(candidates: list[str]) -> dict[str, Column]:
    """Each variant's product of a component whose candidates are columns, structs (place, product, price, ...), null where the product isn't known."""
    first = lambda *order: _least([F.when(F.col(c).isNotNull(), F.struct(*(o(c).alias(f"o{i}") for i, o in enumerate(order)), F.col(c).alias("c"))) for c in candidates])["c"]
    price, place = lambda c: _price(f"{c}.price"), lambda c: F.col(f"{c}.place")
    return {"budget": first(price, place), "standard": first(place), "premium": first(lambda c: -price(c), place)}


def added_products(wanted: DataFrame, chosen: DataFrame, grouping: str = "scope", *more: str) -> DataFrame:
    """`template_lines` of components that carry their pack's selected recommendation and each variant's product as a struct (product, more).

    Products of lines are taken out by an aggregate over both, which stays where rows are dealt by quote; a join by three columns would deal them anew.
    """
    picks = [F.struct(F.lit(v).alias("variant"), F.struct(*(F.col(f"{v}.{c}") for c in ("product", *more))).alias("c")) for v in VARIANTS]
    each = F.explode(F.when(F.col("required"), F.array(*picks)).otherwise(F.array(picks[VARIANTS.index("premium")])))
    room = {"pack": _filled("title"), "area": F.concat(F.lit(f"{PACK}: "), _filled("scope_label")), "scope": _filled("scope_label", "title", last=PACK)}[grouping]
    note = F.concat_ws(" · ", F.lit(PACK), "template", "label", F.concat(F.lit("PA: "), _filled("title")))
    found = wanted.select(
        "quote", F.coalesce(F.nullif(F.col("qty").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("qty"), room.alias("room"), note.alias("note"), F.struct("pack_place", "scope", "component").alias("place"), _filled("label").alias("shown"), each.alias("v")
    )
    found = found.select("quote", "v.variant", "v.c.product", "qty", "room", "note", "place", "shown", *(F.col(f"v.c.{m}") for m in more)).where("product is not null")
    both = found.unionByName(chosen.select("quote", "variant", "product", F.lit(True).alias("used")), allowMissingColumns=True)
    # a column each, so that those without use are not made and sorted; a variant's places are unlike
    line = [F.min_by(c, "place").alias(c) for c in ("qty", "room", "note", "shown", *more)]
    return both.groupBy("quote", "variant", "product").agg(F.min("place").alias("place"), F.max("used").alias("used"), *line).where("place is not null and used is null").drop("used")


def rooms(lines: DataFrame, chosen: DataFrame, added: DataFrame) -> DataFrame:
    """(quote, variant, room, product, note, qty, factor, source, template, place): equal products and notes of a room are one line with the sum of quantities.

    lines as `line_rooms` gives them, chosen: quote, variant, line, product. `template` and `place` order lines; a template's places start anew.
    """
    return merged_rooms(chosen.select("quote", "variant", "line", "product").join(lines, ["quote", "line"]), added)


def merged_rooms(own: DataFrame, added: DataFrame) -> DataFrame:
    """`rooms` of lines that have their chosen products."""
    own = own.select("quote", "variant", "room", "product", "note", "qty", F.lit(False).alias("template"), F.struct(F.col("place").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("place"))
    more = added.select("quote", "variant", "room", "product", "note", "qty", F.lit(True).alias("template"), F.struct(F.col("place.pack_place").cast("long").alias("a"), F.col("place.component").cast("long").alias("b")).alias("place"))
    merged = own.unionByName(more).groupBy("quote", "variant", "room", "product", "note").agg(F.sum("qty").alias("qty"), F.min(F.struct("template", "place")).alias("at"))
    return merged.select("*", F.lit(1.0).alias("factor"), F.when(F.col("at.template"), "pack_template").otherwise("bom_line").alias("source"), F.col("at.template").alias("template"), F.col("at.place").alias("place")).drop("at")


def variants(lines: DataFrame, chosen: DataFrame, added: DataFrame, products: DataFrame, labour_percent: float = 0.0) -> DataFrame:
    """One row a quote and variant, also where nothing matched: totals, counts, labour, profit, margin, coverage, and the first unmatched lines.

    products: product, price, cost. A template line counts one item and one piece whatever its quantity, as the reference has it.
    """
    priced = products.select("product", "price", "cost", F.lit(True).alias("known"))
    each = lines.withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    own = each.join(chosen.select("quote", "variant", "line", "product", (F.col("source") == "user_locked").alias("locked")), ["quote", "variant", "line"], "left").join(priced, "product", "left")
    return variant_sums(own.withColumn("placed", F.lit(True)), added.join(priced, "product"), labour_percent)


def variant_sums(own: DataFrame, added: DataFrame, labour_percent: float = 0.0) -> DataFrame:
    """`variants` in one aggregate by quote and variant, so that rows dealt by quote stay where they are.

    own: quote, variant, place, line, shown, qty, product (null where nothing matched), locked, price, cost, whether the product
    is known and the line is placed, one row for each variant of a line; added: quote, variant, qty, price, cost.
    """
    both = own.select("quote", "variant", "place", "line", "shown", "qty", F.col("qty").alias("pieces"), "price", "cost", F.coalesce("locked", F.lit(False)).alias("locked"), F.lit(False).alias("template"),
        (F.col("product").isNotNull() & F.coalesce("known", F.lit(False)) & F.col("placed")).alias("counts"), (F.col("product").isNull() & F.col("placed")).alias("open")
    ).unionByName(added.select("quote", "variant", "qty", F.lit(1.0).alias("pieces"), "price", "cost", F.lit(False).alias("locked"), F.lit(True).alias("template"), F.lit(True).alias("counts"), F.lit(False).alias("open")), allowMissingColumns=True)
    # a bounded rank, so no group is collected; the aggregate reads rows as the rank has sorted them
    both = both.withColumn("r", F.row_number().over(Window.partitionBy("quote", "variant", "open").orderBy("place", "line")))
    total = lambda x: F.coalesce(F.sum(F.when(F.col("counts"), x)), F.lit(0.0))
    price, cost = (F.coalesce(F.col(c), F.lit(0.0)) * F.col("qty") for c in ("price", "cost"))
    sums = both.groupBy("quote", "variant").agg(
        F.count_if(~F.col("template")).alias("n_lines"), total(price).alias("device_total"), total(cost).alias("cost_total"), total(F.col("pieces")).alias("qty_total"), F.count_if("counts").alias("items"),
        F.count_if(F.col("counts") & F.col("locked")).alias("locked"), F.count_if("template").alias("template_lines"), F.count_if(F.col("counts") & ~F.col("template")).alias("matched"),
        *(F.max(F.when(F.col("open") & (F.col("r") == i), F.col("shown"))).alias(f"sample_{i}") for i in range(1, SAMPLE + 1)),
    )
    counted = ("device_total", "cost_total", "qty_total")
    labour, profit = half_up(F.col("device_total") * labour_percent / 100).cast("double"), F.greatest(F.lit(0.0), F.col("device_total") - F.col("cost_total"))
    percent = lambda part, whole: F.when(whole > 0, half_up(part / whole * 100)).otherwise(0).cast("long")
    return sums.where("n_lines > 0").select(
        "quote", "variant", *counted, "items", "locked", (F.col("items") - F.col("locked")).alias("auto"), "matched", (F.col("n_lines") - F.col("matched")).alias("unmatched"), "template_lines", labour.alias("labour"),
        (F.col("device_total") + labour).alias("grand_total"), profit.alias("profit"), percent(profit, F.col("device_total")).alias("margin_percent"), percent(F.col("matched"), F.col("n_lines")).alias("coverage"),
        (F.col("items") > 0).alias("ready"), F.array_compact(F.array(*(f"sample_{i}" for i in range(1, SAMPLE + 1)))).alias("unmatched_sample"),
    )
