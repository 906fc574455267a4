"""Views of a bill's lines by state, and the solution that a takeoff column belongs to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of supporting lines, and the key of their solution.
SUPPORTING_WORDS = "cáp|cap|dây|day|ống|ong|phụ kiện|phu kien|nhân công|nhan cong|hạ tầng|ha tang"
INFRASTRUCTURE = "infrastructure"
# Solutions, and the groups and categories that lead to them; the first that fits counts.
LIGHT = "I./ Giải pháp chiếu sáng tự động thông minh\n(Điều khiển tắt/mở đèn từ xa qua Smart Phone, hẹn giờ, cảm ứng…)"
SENSORS, GATES, CAMERAS = "II./ Hệ thống cảm biến", "III./ Giải pháp cổng tự động thông minh", "IV./ Giải pháp camera an ninh"
NETWORK, SOUND, CURTAINS = "V./ Hệ thống mạng nội bộ + Wifi", "VI./ Giải pháp âm thanh đa vùng", "VIII./ Giải pháp rèm thông minh"
GROUPS = [
    ("công tắc thông minh", LIGHT), ("công tắc", LIGHT), ("ổ cắm", LIGHT), ("chiếu sáng", LIGHT), ("đèn", LIGHT), ("cb thông minh", SENSORS), ("cảm biến", SENSORS), ("cb", SENSORS), ("cổng tự động", GATES),
    ("cổng", GATES), ("camera", CAMERAS), ("an ninh", CAMERAS), ("wifi", NETWORK), ("mạng", NETWORK), ("mạng/wifi", NETWORK), ("âm thanh", SOUND), ("rèm", CURTAINS),
]
CATEGORIES = [
    ("Công tắc", LIGHT), ("Ổ cắm", LIGHT), ("Chiếu sáng", LIGHT), ("Điều khiển", LIGHT), ("Cảm biến", SENSORS), ("Cổng tự động", GATES), ("Camera", CAMERAS), ("An ninh", CAMERAS),
    ("Mạng/Wifi", NETWORK), ("Module", NETWORK), ("Âm thanh", SOUND), ("Rèm", CURTAINS),
]
MODES = ("core", "supporting", "ready", "review", "matched", "unresolved", "ignored", "all")


def is_supporting(line: Column, scope: Column, solution: Column, *texts: Column) -> Column:
    """Whether a line or its scope is marked, its solution is infrastructure, or its label, category or name speaks of cables and the like."""
    spoken = F.lower(F.concat_ws(" ", *texts)).rlike(SUPPORTING_WORDS)
    return F.coalesce(scope, F.lit(False)) | F.coalesce(line, F.lit(False)) | (F.coalesce(solution, F.lit("")) == INFRASTRUCTURE) | spoken


def shown(mode: str, show_supporting: bool = False) -> Column:
    """Whether a line (ignored, supporting, product, status) belongs to a view; `scope:` and an id is the view of a scope (column scope).

    Ignored lines are in the views of ignored ones and of all only; supporting lines are left out of views by state unless asked for.
    """
    ignored, supporting, product = F.coalesce("ignored", F.lit(False)), F.col("supporting"), F.col("product").isNotNull()
    if mode == "ignored":
        return ignored
    if mode.startswith("scope:"):
        return ~ignored & F.coalesce(F.col("scope") == mode.removeprefix("scope:"), F.lit(False))
    fits = F.lit(True) if show_supporting else ~supporting
    status = lambda s: F.coalesce(F.col("status") == s, F.lit(False))
    by_mode = {"core": ~supporting, "supporting": supporting, "ready": status("ready") & fits, "review": status("need_review") & fits, "matched": product & fits, "unresolved": ~product & fits}
    return ~ignored & by_mode[mode] if mode in by_mode else ignored | fits


def view_counts(lines: DataFrame, by: str, show_supporting: bool = False) -> DataFrame:
    """Per group how many lines each view has."""
    return lines.groupBy(by).agg(*(F.count_if(shown(m, show_supporting)).alias(m) for m in MODES))


def solution_of(group: Column, category: Column) -> Column:
    """The solution by the column's group, equal or within one another, else by the product's category, equal or within it, else the first."""
    own, kind = F.lower(F.trim(F.coalesce(group, F.lit("")))), F.coalesce(category, F.lit(""))
    first = lambda rules, test: reduce(lambda rest, r: F.when(test(F.lit(r[0])), F.lit(r[1])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    by_group = F.coalesce(first(GROUPS, lambda k: own == k), first(GROUPS, lambda k: F.contains(own, k) | F.contains(k, own)))
    by_kind = F.coalesce(first(CATEGORIES, lambda k: kind == k), first(CATEGORIES, lambda k: F.contains(F.lower(kind), F.lower(k))))
    return F.coalesce(F.when(own != "", by_group), by_kind, F.lit(LIGHT))
