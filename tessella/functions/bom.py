"""Lines of bills of materials: models, names, categories, solution families, status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.patterns import first_of, plain
from tessella.functions.products import quantity
from tessella.functions.text import BOUNDARY, clean_text

# Header words by field; words of technical goods, of rows that are none, of areas; names that say nothing.
HEADER_HINTS = {
    "name": ["ten goi va quy cach", "ten goi va qui cach", "ten goi va thong so", "ten goi va dac tinh", "ten goi", "ten vat tu", "ten thiet bi", "ten cong tac", "ten cong viec", "ten hang muc", "thiet bi", "hang muc", "noi dung", "mo ta", "description", "item", "product", "ten hang", "ten san pham"],
    "model": ["model", "ma vat tu", "ma thiet bi", "ma sp", "ma san pham", "sku", "part no", "part number", "code"],
    "qty": ["so luong", "sl", "qty", "quantity", "khoi luong", "volume"],
    "unit": ["dvt", "don vi", "unit", "uom"],
    "unit_price": ["don gia", "unit price", "gia ban", "gia", "price"],
    "amount": ["thanh tien", "amount", "total", "tong tien"],
    "area": ["phong", "khu vuc", "area", "room", "tang", "floor", "vi tri", "location"],
    "note": ["ghi chu", "note", "remark", "dien giai", "spec", "thong so", "quy cach", "quy cach ky thuat", "mo ta"],
}
TECHNICAL = [
    "cong tac", "cam bien", "den", "downlight", "spotlight", "camera", "nvr", "dau ghi", "switch", "wifi", "router", "khoa", "chuong", "man hinh", "bo dieu khien", "module", "relay", "rem", "dong co", "loa", "am thanh",
    "cap", "ong", "tu dien", "nguon", "adapter", "ray", "sensor", "access", "door", "exit", "led", "driver", "dieu hoa", "dan lanh", "dan nong", "cassette", "vrv", "vrf", "ong dong", "ong gas",
]
NO_PRODUCT = ["tong cong", "subtotal", "total", "vat", "thue", "chiet khau", "giam gia", "ghi chu", "dieu khoan", "thanh toan", "bao hanh", "lap dat", "thi cong", "nhan cong", "van chuyen", "note", "remark"]
AREA_WORDS = ["phong", "khu vuc", "tang", "floor", "area", "zone", "hang muc", "he thong", "giai phap", "san pham", "noi that", "dien nhe", "camera", "lighting", "smarthome"]
EMPTY_NAMES = ["vat tu", "thiet bi", "hang muc", "san pham", "phu kien", "bo", "combo"]
MODELS = [r"\b[A-Z]{1,5}[-_][A-Z0-9]{2,}(?:[-_][A-Z0-9]{1,}){0,5}\b", r"\b[A-Z]{2,}[0-9]{2,}[A-Z0-9-]*\b", r"\b[0-9]{2,}[A-Z]{1,}[A-Z0-9-]*\b"]
NO_MODELS = ["VAT", "VND", "USD", "AC", "DC", "IP", "COB", "SMD", "LED"]
CATEGORIES = [
    ("Điều hòa / HVAC", "dieu hoa|dan lanh|dan nong|cassette|vrv|vrf|ong dong|ong gas|hvac"), ("Camera", "camera|dau ghi|nvr|hikvision|dahua"),
    ("Công tắc / Điều khiển", "cong tac|o cam|relay|module|dieu khien"), ("Cảm biến", "cam bien|sensor"), ("Chiếu sáng", "den|downlight|spotlight|led|lighting|driver"),
    ("An ninh / Access", "khoa|chuong|door|exit|access"), ("Mạng / Điện nhẹ", "wifi|router|switch|mang|cap"), ("Rèm / Motor", "rem|dong co"), ("Âm thanh", "loa|am thanh"),
]
# Disciplines of sheets, and families of solutions with their words; of equal scores the first counts.
DISCIPLINES = {
    "hvac": ["dieu hoa", "hvac", "dan lanh", "dan nong", "cassette", "vrv", "vrf", "ong dong", "ong gas", "multi", "fcdu"],
    "smart_home": ["dtm", "dien thong minh", "smarthome", "smart home", "cong tac thong minh", "chuong hinh", "cam bien", "motor rem", "khoa thong minh"],
    "lighting": ["chieu sang", "lighting", "downlight", "spotlight", "den led", "den ray", "den san vuon", "canh quan"],
    "camera_security": ["camera", "an ninh", "dau ghi", "nvr", "hikvision", "dahua", "imou", "access control", "kiem soat"],
    "network_low_voltage": ["mang", "dien nhe", "wifi", "router", "switch", "cat6", "mesh", "tu dien nhe"],
    "mep_infrastructure": ["cap", "day dien", "ong", "tu dien", "mcb", "hao cap", "tiep dia", "cot den", "mong den"],
}
TITLES = [("smart_home", "dtm|dien thong minh|smarthome|smart home"), ("lighting", "chieu sang|lighting|den led|downlight|spotlight"), ("hvac", "dieu hoa|hvac|dan lanh|dan nong|cassette|vrv|vrf")]
LIST_WORDS = "ten goi|ten vat tu|ten cong tac|khoi luong|so luong|don vi|dvt"
FAMILIES = {
    "hvac": ["dieu hoa", "dan lanh", "dan nong", "cassette", "vrv", "vrf", "ong dong", "ong gas", "hvac", "multi"],
    "audio_multiroom": ["am thanh", "loa", "audio", "speaker", "arylic", "ampli", "amply", "multiroom"],
    "door_phone": ["chuong hinh", "camera chuong", "man hinh chuong", "door phone", "basip", "bas-ip", "intercom"],
    "smart_switch_control": ["cong tac", "phim dieu khien", "bo ket noi dieu khien", "xu ly tin hieu", "input", "relay", "module", "o cam", "dieu khien chieu sang", "dimmer"],
    "smart_lighting": ["chieu sang", "lighting", "den", "downlight", "spotlight", "led", "driver", "ray nam cham", "dali", "0-10v"],
    "sensors": ["cam bien", "sensor", "hien dien", "chuyen dong", "pir", "bim", "cua cuon", "mg"],
    "curtain_gate_motor": ["motor", "rem", "dong co", "cong tu dong", "roger", "vulcan", "ray rem"],
    "smart_lock_access": ["khoa", "the vao ra", "doc the", "nhan dien khuon mat", "access", "kiem soat", "door exit", "van tay"],
    "camera_security": ["camera", "dau ghi", "nvr", "hik", "hikvision", "dahua", "imou", "an ninh ai"],
    "network_wifi": ["wifi", "mesh", "router", "switch", "mang", "cat6", "ruijie", "lan"],
    "infrastructure": ["cap", "day", "ong", "hdpe", "pvc", "tu dien", "nguon", "adapter", "nhan cong", "phu kien", "mcb", "hao cap", "tiep dia"],
}
BONUS = {("hvac", "hvac"): 2, ("lighting", "smart_lighting"): 2, **{("smart_home", f): 1 for f in ("smart_switch_control", "door_phone", "sensors", "audio_multiroom")}}
SUPPORTING = "infrastructure"


def has_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def numeric_like(x: Column) -> Column:
    return F.regexp_replace(clean_text(x), r"[,.\s]", "").rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")


def model_of(x: Column) -> Column:
    """The longest token that is shaped like a model, the first of equals; '' without one."""
    text = clean_text(x)
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p.replace(r"\b", BOUNDARY)), F.lit(0)) for p in MODELS))
    good = F.filter(found, lambda m: ~m.isin(NO_MODELS))
    best = F.array_max(F.transform(good, lambda m, i: F.struct(F.length(m).alias("n"), (-i).alias("early"), m.alias("model"))))
    return F.coalesce(best["model"], F.lit(""))


def bare_name(x: Column, model: Column) -> Column:
    """Without numbering, unit tags and the first place of the model as a word of its own."""
    s = F.regexp_replace(clean_text(x), r"^[0-9]+[.)]\s*", "")
    s = F.trim(F.regexp_replace(s, "(?iu)" + BOUNDARY + "(SL|QTY|DVT|ĐVT)" + BOUNDARY + r"\s*[:：]?\s*[0-9]*\s*", ""))
    first = F.concat(F.lit("(?is)^(.*?)" + BOUNDARY + r"\Q"), model, F.lit(r"\E" + BOUNDARY))
    cut = F.trim(F.regexp_replace(F.regexp_replace(s, first, F.lit("$1")), "[-–—|]+$", ""))
    return F.when(model == "", s).when(F.upper(s) == F.upper(model), "").otherwise(cut)


def product_like(x: Column) -> Column:
    """A technical word, or two words and eight characters; never a note, a total or a name that says nothing."""
    n = plain(x)
    fits = has_any(n, TECHNICAL) | ((F.size(F.split(n, r"\s+")) >= 2) & (F.length(n) >= 8))
    return (F.length(n) >= 4) & ~has_any(n, NO_PRODUCT) & ~n.isin(EMPTY_NAMES) & fits


def category_of(x: Column) -> Column:
    return F.coalesce(first_of(plain(x), CATEGORIES, lambda t, p: t.rlike(p)), F.lit("Khác"))


def _best(scores: list[tuple[str, Column]]) -> Column:
    return F.array_max(F.array(*(F.struct(score.alias("score"), F.lit(-k).alias("early"), F.lit(name).alias("name")) for k, (name, score) in enumerate(scores))))


def family_of(text: Column, discipline: Column) -> Column:
    """(family, confidence, supporting): four points for each long word of a family, two for a short one, and the sheet's bonus."""
    scores = []
    for family, words in FAMILIES.items():
        score = sum((F.when(F.contains(text, F.lit(w)), 4 if len(w) >= 8 else 2).otherwise(0) for w in words), F.lit(0))
        for (d, f), more in BONUS.items():
            if f == family:
                score = score + F.when(discipline == d, more).otherwise(0)
        scores.append((family, score))
    best = _best(scores)
    name = F.when(best["score"] > 0, best["name"]).otherwise("other")
    sure = F.when(best["score"] >= 5, "high").when(best["score"] >= 3, "medium").otherwise("low")
    return F.struct(name.alias("family"), sure.alias("confidence"), (name == SUPPORTING).alias("supporting"))


def discipline_of(title: Column, text: Column) -> Column:
    """(discipline, score, included) of a sheet: words in the title count most, some titles decide alone, lists of goods are read whatever they are."""
    scores = []
    for d, words in DISCIPLINES.items():
        score = sum((F.when(F.contains(title, F.lit(w)), 8.0 if len(w) > 8 else 5.0).when(F.contains(text, F.lit(w)), 3.0 if len(w) > 8 else 1.5).otherwise(0.0) for w in words), F.lit(0.0))
        scores.append((d, score))
    best = _best(scores)
    named = F.coalesce(*(F.when(title.rlike(p), F.lit(d)) for d, p in TITLES))
    key = F.coalesce(named, F.when(best["score"] > 0, best["name"]).otherwise("unknown"))
    score = F.when(named.isNotNull(), F.greatest(best["score"], F.lit(20.0))).otherwise(best["score"])
    listed = (score < 4) & text.rlike(LIST_WORDS)
    return F.struct(
        F.when(listed & (key == "unknown"), "generic_bom").otherwise(key).alias("discipline"), F.when(listed, F.greatest(score, F.lit(3.0))).otherwise(score).alias("score"), ((score >= 4) | listed).alias("included")
    )


def scope_id(family: Column) -> Column:
    return F.concat(F.lit("scope_"), F.regexp_replace(F.coalesce(F.nullif(family, F.lit("")), F.lit("other")), "[^A-Za-z0-9_-]", "_"))


def line_status(name: Column, qty: Column, model: Column) -> Column:
    """(status, n_issues): ready without issues, or with a missing model as the only one."""
    vague, none, unknown, long = (name == "") | ~product_like(name), F.coalesce(qty, F.lit(0.0)) <= 0, model == "", F.length(name) > 130
    n = sum((F.when(c, 1).otherwise(0) for c in (vague, none, unknown, long)), F.lit(0))
    ready = (n == 0) | ((n == 1) & unknown)
    return F.struct(F.when(ready, "ready").otherwise("need_review").alias("status"), n.alias("n_issues"))


def header_score(text: Column) -> Column:
    """Points of a row of cells as the header of a list: name and quantity count most, and more together."""
    cells = F.transform(text, lambda t: plain(t))
    has = {f: F.exists(cells, lambda c: c.rlike("|".join(words))) for f, words in HEADER_HINTS.items()}  # noqa: B023
    points = sum((F.when(h, 4 if f in ("name", "qty") else 2).otherwise(0) for f, h in has.items()), F.lit(0))
    return points + F.when(has["name"] & has["qty"], 6).otherwise(0) + F.when(has["unit"], 2).otherwise(0)


def area_of(text: Column, qty_col: int | None = None) -> Column:
    """The label of a row of up to three cells that names an area, or null; a row with a quantity in that column is none."""
    filled = F.filter(F.transform(text, lambda t: clean_text(t)), lambda t: t != "")
    whole, head = plain(F.array_join(filled, " ")), F.get(filled, F.lit(0))
    named = has_any(whole, AREA_WORDS) | ((F.length(head) >= 4) & (head == F.upper(head))) | (has_any(whole, TECHNICAL) & (F.length(head) < 60))
    label = F.coalesce(F.get(F.filter(filled, lambda t: ~t.rlike("(?i)^(?:[IVXLCDM]+|[0-9]+)$")), F.lit(0)), head)
    fits = F.size(filled).between(1, 3) & (whole != "") & ~has_any(whole, NO_PRODUCT) & named
    if qty_col is not None:
        fits = fits & quantity(F.get(text, F.lit(qty_col))).isNull()
    return F.when(fits, F.regexp_replace(label, r"^[0-9]+[.)]\s*", ""))
