"""Column builders for Japanese market data: codes, figures, units, titles, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Full-width characters and their ASCII forms, signs of negative figures, units in yen, what a code looks like.
WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SIGNS, PLAIN = "０１２３４５６７８９△▲▴−ー―‐，．", "0123456789-------,."
UNITS = {"円": 1, "千円": 1_000, "百万円": 1_000_000, "億円": 100_000_000, "兆円": 1_000_000_000_000}
CODE = "^[0-9]{3}[0-9A-Z]$"
UNIT = "百万円|千円|億円|兆円|円"
FIGURE = r"-?\s*[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?"
#: Metrics of a forecast, by priority.
METRICS = ["営業利益", "経常利益", "親会社株主に帰属する当期純利益", "当期純利益", "売上高"]


def stock_code(raw: Column) -> Column:
    """Trimmed, in ASCII, upper case; empty for null."""
    return F.coalesce(F.upper(F.translate(F.trim(raw), WIDE, NARROW)), F.lit(""))


def parsed_code(raw: Column) -> Column:
    code = stock_code(raw)
    return F.when(code.rlike(CODE), code)


def ticker(raw: Column) -> Column:
    """A four-character code, also of a five-character one that ends in 0."""
    code = stock_code(raw)
    head = F.when((F.length(code) == 5) & code.endswith("0"), F.substring(code, 1, 4)).otherwise(code)
    return F.when(head.rlike(CODE), head)


def margin_key(raw: Column) -> Column:
    """The ticker; a class of shares keeps its fifth character."""
    code = stock_code(raw)
    return F.coalesce(ticker(raw), F.when((F.length(code) == 5) & F.substring(code, 1, 4).rlike(CODE) & F.substring(code, 5, 1).rlike("[1-9]"), code))


def plain_figure(text: Column) -> Column:
    return F.translate(text, SIGNS, PLAIN)


def figure(text: Column) -> Column:
    """A whole text as a number; null if it is none."""
    bare = F.regexp_replace(plain_figure(text), r"[\s,]", "")
    return F.when(bare.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), bare.cast("double"))


def accounting_figure(text: Column) -> Column:
    """A number that parentheses or a triangle make negative; dashes are null."""
    bare = F.regexp_replace(plain_figure(F.translate(text, "（）", "()")), r"[\s,]", "")
    return figure(F.regexp_replace(bare, r"^\((.*)\)$", "-$1"))


def unit_factor(unit: Column) -> Column:
    """Yen per unit; none is yen, an unknown one null."""
    out = F.when(unit == "", 1.0)
    for name, factor in UNITS.items():
        out = out.when(unit == name, float(factor))
    return out


def amount(text: Column) -> Column:
    """The first figure of a text times the first unit; without separators a figure is read to its third digit, as published."""
    norm = plain_figure(text)
    return figure(F.regexp_extract(norm, FIGURE, 0)) * unit_factor(F.regexp_extract(norm, UNIT, 0))


def figures_behind(norm: Column, key: str, window: int = 200) -> Column:
    """The first two figures with a unit, as (n, unit), within `window` characters behind the key in a text of plain figures."""
    stretch = F.substring(norm, F.instr(norm, key), F.lit(len(key) + window))
    found = F.transform(F.regexp_extract_all(stretch, F.lit(rf"{FIGURE}\s*(?:{UNIT})"), F.lit(0)), lambda m: F.struct(figure(F.regexp_extract(m, FIGURE, 0)).alias("n"), F.regexp_extract(m, UNIT, 0).alias("unit")))
    return F.when(F.instr(norm, key) > 0, F.slice(F.filter(found, lambda x: x["n"].isNotNull() & (x["unit"] != "兆円")), 1, 2))


def with_forecast_revision(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the side of a forecast revision: positive, negative, mixed or unknown.

    A metric moves from its first figure to its second, if both have one unit. The first metric that moves gives the side, one that moves the
    other way makes it mixed; net profit does not count beside the parent's. In steps, so that no expression is worked out twice.
    """
    df = df.withColumn("_norm", plain_figure(F.col(text)))
    df = df.withColumns({f"_pair{i}": figures_behind(F.col("_norm"), key) for i, key in enumerate(METRICS)})
    at = lambda i, j: F.get(F.col(f"_pair{i}"), F.lit(j))
    way = lambda i: F.when((F.size(f"_pair{i}") == 2) & (at(i, 0)["unit"] == at(i, 1)["unit"]), F.signum(at(i, 1)["n"] - at(i, 0)["n"]))
    df = df.withColumns({f"_way{i}": way(i) for i in range(len(METRICS))})
    own = [F.when(F.col("_way2").isNull(), F.col("_way3")) if i == 3 else F.col(f"_way{i}") for i in range(len(METRICS))]
    df = df.withColumn("_ways", F.filter(F.array_compact(F.array(*own)), lambda w: w != 0))
    first = F.get("_ways", F.lit(0))
    side = F.when(first.isNull(), "unknown").when(F.array_contains("_ways", -first), "mixed").when(first > 0, "positive").otherwise("negative")
    return df.withColumn(name, side).drop("_norm", "_ways", *(f"_{x}{i}" for i in range(len(METRICS)) for x in ("pair", "way")))


def cell_interval(value: Column, quantum: Column, mode: Column) -> Column:
    """(lo, hi) of what a printed value can stand for: truncated toward zero, rounded, or either."""
    low = F.when(mode == "truncate", F.when(value < 0, value - quantum).otherwise(value)).when(mode == "round", value - quantum / 2).otherwise(value - quantum)
    high = F.when(mode == "truncate", F.when(value > 0, value + quantum).otherwise(value)).when(mode == "round", value + quantum / 2).otherwise(value + quantum)
    return F.struct(low.alias("lo"), high.alias("hi"))


def overlapping(a: Column, b: Column, slack: float = 1e-9) -> Column:
    return (a["lo"] <= b["hi"] + slack) & (b["lo"] <= a["hi"] + slack)


def period(day: Column, kind: Column) -> Column:
    """(first, last) day of the day, week, month, quarter or year around a day."""
    month = F.trunc(day, "MM")
    quarter = F.trunc(day, "quarter")
    start = F.when(kind == "week", F.trunc(day, "week")).when(kind == "month", month).when(kind == "quarter", quarter).when(kind == "year", F.trunc(day, "year")).otherwise(day)
    end = F.when(kind == "week", F.date_add(F.trunc(day, "week"), 6)).when(kind == "month", F.last_day(day)).when(kind == "quarter", F.last_day(F.add_months(quarter, 2))).when(kind == "year", F.last_day(F.add_months(F.trunc(day, "year"), 11))).otherwise(day)
    return F.struct(start.alias("first"), end.alias("last"))


def adjustment(close: Column, adjusted: Column) -> Column:
    """Adjusted close over close; null unless both are positive."""
    return F.when((close > 0) & (adjusted > 0), adjusted / close)


# The tags of disclosure titles, in order: (tag, high signal, polarity, ways to have it, words that must not be there). A way is groups of words, one of each of which must be there.
TAGS: list[tuple[str, bool, str, list[list[list[str]]], list[str]]] = [
    ("上方修正", True, "positive", [[["上方修正", "上振れ"]]], ["下方修正"]),
    ("下方修正", True, "negative", [[["下方修正", "下振れ"]]], []),
    ("増配", True, "positive", [[["増配"]]], []),
    ("減配・無配", True, "negative", [[["減配", "無配"]]], []),
    ("配当政策の変更", True, "neutral", [[["配当方針", "配当政策", "株主還元方針", "累進配当", "配当性向", "株主還元の方針"], ["変更", "見直し", "改定", "導入", "決定", "方針", "策定"]], [["株主還元方針"]]], []),
    ("自社株買い", True, "positive", [[["自己株式の取得", "自社株買い", "自己株式取得"]], [["自己株式"], ["立会外買付", "ToSTNeT", "取得状況"]]], []),
    ("自己株式の消却", True, "positive", [[["自己株式の消却", "自己株式消却"]]], []),
    ("配当(決定・予想)", False, "neutral", [[["配当予想", "剰余金の配当", "配当の予想", "配当金", "復配", "記念配当", "特別配当"]]], []),
    ("業績予想の修正", False, "neutral", [[["業績予想", "通期予想", "連結業績予想"], ["修正", "変更"]]], ["上方修正", "下方修正"]),
    ("決算短信", False, "neutral", [[["決算短信"]]], []),
    ("特別損益", False, "neutral", [[["特別損失", "特別利益", "特損", "減損損失", "減損の計上"]]], []),
    ("株式分割・併合", False, "neutral", [[["株式分割", "株式併合"]]], []),
    ("エクイティファイナンス", False, "neutral", [[["公募増資", "第三者割当", "新株式発行", "募集株式", "新株予約権", "転換社債", "ライツ・オファリング", "売出し", "株式売出"]]], []),
    ("自己株式の処分", False, "neutral", [[["自己株式の処分"]]], []),
    ("M&A・資本提携", False, "neutral", [[["株式取得", "子会社化", "合併", "事業譲渡", "資本業務提携", "資本提携", "公開買付", "TOB", "株式交換", "株式移転", "連結子会社"]]], []),
    ("月次・速報", False, "neutral", [[["月次"]], [["売上高"], ["速報", "概況"]]], []),
    ("重要事象(調査等)", False, "neutral", [[["特別調査委員会", "第三者委員会", "不適切", "不正", "行政処分", "課徴金", "業務改善命令", "内部統制の不備"]]], []),
    ("上場・市場区分", False, "neutral", [[["新規上場", "上場廃止", "市場区分の変更", "市場変更", "監理銘柄", "整理銘柄", "上場維持基準"]]], []),
    ("人事・組織", False, "neutral", [[["代表取締役", "役員人事", "役員の異動", "人事異動", "組織変更", "経営体制"]]], []),
    ("訂正・取消", False, "neutral", [[["訂正", "取消", "取り消し"]]], []),
]
# What keeps a title that names a delisting or listing from being one.
NOT_YET = ["該当しない", "抵触しない", "非該当", "回避", "おそれ", "可能性", "猶予", "解除", "解消", "見送り", "中止", "撤回", "優先株式", "優先出資", "種類株式", "新株予約権付社債", "優先証券"]
OTHERS = ["子会社", "孫会社", "対象者", "関連会社", "持分法"]


def holds(text: Column, words: list[str]) -> Column:
    return F.lit(False) if not words else F.array_contains(F.array(*(F.contains(text, F.lit(w)) for w in words)), True)


def title_tags(text: Column) -> Column:
    """The tags of a title in its compatibility form (passages.compatible), in the list's order."""

    def has(ways: list[list[list[str]]]) -> Column:
        out = F.lit(False)
        for groups in ways:
            way = F.lit(True)
            for group in groups:
                way = way & holds(text, group)
            out = out | way
        return out

    return F.array_compact(F.array(*(F.when(has(ways) & ~holds(text, bars), F.lit(tag)) for tag, _, _, ways, bars in TAGS)))


def primary_tag(tags: Column) -> Column:
    """The first tag of high signal, else the first."""
    strong = [tag for tag, high, *_ in TAGS if high]
    return F.coalesce(F.get(F.filter(tags, lambda t: t.isin(strong)), F.lit(0)), F.get(tags, F.lit(0)))


def sentiments(tags: Column) -> Column:
    """The sides that the tags take, sorted."""
    side = lambda name: F.when(F.arrays_overlap(tags, F.array(*(F.lit(t) for t, _, p, *_ in TAGS if p == name))), name)
    return F.array_compact(F.array(side("negative"), side("positive")))


def genuine(title: Column) -> Column:
    """Whether a title that names a listing or delisting announces one of the company itself."""
    third = ~F.contains(title, F.lit("子会社化")) & holds(title, OTHERS)
    derived = F.contains(title, F.lit("修正")) & holds(title, ["に伴う", "に関連"])
    return ~holds(title, NOT_YET) & ~third & ~derived


# What joins the old and the new number of shares, and what may stand between "effective date" and the date.
PAIR = r"([0-9]+)[\s\x{3000}]*株?[\s\x{3000}]*(?:を|につき|対|:)[\s\x{3000}]*([0-9]+)[\s\x{3000}]*株"
RATIO = r"([0-9]+)[\s\x{3000}]*[:対][\s\x{3000}]*([0-9]+)"
EFFECTIVE = r"効力発生日?[\s\x{3000}（(:：・,，。．をはがと/／]{0,6}([0-9]{4})[\s\x{3000}]*年[\s\x{3000}]*([0-9]{1,2})[\s\x{3000}]*月[\s\x{3000}]*([0-9]{1,2})[\s\x{3000}]*日"


def split_terms(title: Column) -> Column:
    """(terms, factor) of "1株を3株", "1株につき３株", "1対3" or "1:3": old and new shares as text, and new over old; null without both or with a zero."""
    text = F.translate(title, "０１２３４５６７８９：", "0123456789:")
    pattern = F.when(text.rlike(PAIR), 1).when(text.rlike(RATIO), 2)
    part = lambda i: F.when(pattern == 1, F.regexp_extract(text, PAIR, i)).when(pattern == 2, F.regexp_extract(text, RATIO, i)).try_cast("long")
    old, new = part(1), part(2)
    return F.when((old > 0) & (new > 0), F.struct(F.concat_ws(":", old.cast("string"), new.cast("string")).alias("terms"), (new / old).alias("factor")))


def effective_date(title: Column) -> Column:
    """The date right behind "effective date"; null if there is none or it is no day of the calendar."""
    text = F.translate(title, "０１２３４５６７８９：", "0123456789:")
    part = lambda i: F.regexp_extract(text, EFFECTIVE, i)
    return F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-M-d")).cast("date")


# The types of documents.
DOCUMENT_TYPES = {"results": "短信", "split": "株式分割", "merge": "株式併合", "delisting": "上場廃止", "listing": "新規上場", "forecast": "業績修正", "dividend": "配当修正", "benefit": "優待", "buyback": "自社株買い", "holding": "大量保有", "annual": "有報", "quarterly": "四半期報告", "other": "その他"}


def document_type(title: Column) -> Column:
    """The type of document that a title announces, by priority.

    A title that names a split or merger of shares without its ratio, and reads like a revision, is the revision.
    """
    has = lambda *words: F.contains(title, F.lit(words[0])) if len(words) == 1 else F.contains(title, F.lit(words[0])) & has(*words[1:])
    split, merge = title.rlike("株式の?分割"), title.rlike("株式の?併合")
    forecast, dividend = has("業績予想", "修正"), has("配当", "修正")
    action = (split | merge) & (split_terms(title).isNotNull() | ~(forecast | dividend))
    rules = {
        "results": has("決算短信"), "split": action & split, "merge": action, "delisting": has("上場廃止") & genuine(title), "listing": has("新規上場") & genuine(title), "forecast": forecast, "dividend": dividend,
        "benefit": has("株主優待"), "buyback": has("自己株式", "取得"), "holding": has("大量保有"), "annual": has("有価証券報告書"), "quarterly": has("四半期報告書"),
    }
    out = F.when(F.lit(False), "")
    for name, rule in rules.items():
        out = out.when(rule, DOCUMENT_TYPES[name])
    return out.otherwise(DOCUMENT_TYPES["other"])


# The tags whose text is judged, and by what.
ENGINES = {"業績予想の修正": "rule_v1_forecast", "配当(決定・予想)": "rule_v1_dividend", "特別損益": "rule_v1_extra", "配当政策の変更": "dict_v1", "エクイティファイナンス": "dict_v1", "自己株式の処分": "dict_v1"}


def engine(tag: Column, text: Column) -> Column:
    """What judges a text by its primary tag: skipped for none or one that its title settles, unknown for a text without characters."""
    name = F.try_element_at(F.create_map(*(F.lit(x) for pair in ENGINES.items() for x in pair)), tag)
    return F.when(name.isNull(), "skipped").when(F.coalesce(F.trim(text), F.lit("")) == "", "unknown").otherwise(name)


# Where a dividend stands, by priority; what losses and gains are called.
DIVIDENDS = ["1 株当たり配当金 合計", "1株当たり配当金合計", "合計 (年間)", "年間配当", "年間", "1 株当たり配当金", "1株当たり配当金", "1 株当たり配当", "1株当たり配当", "期末配当", "中間配当"]
LOSSES = ["特別損失", "減損損失", "特損", "減損の計上", "減損損失の計上"]
GAINS = ["特別利益", "特益"]


def with_dividend_revision(df: DataFrame, text: str, name: str, window: int = 160) -> DataFrame:
    """df with the side of a dividend revision: of the first key whose first two figures in yen, within `window` characters behind it, differ; else unknown."""
    df = df.withColumn("_norm", plain_figure(F.col(text)))
    found = lambda stretch: F.transform(F.regexp_extract_all(stretch, F.lit(rf"{FIGURE}\s*(?:{UNIT})?"), F.lit(0)), lambda m: F.struct(figure(F.regexp_extract(m, FIGURE, 0)).alias("n"), F.regexp_extract(m, UNIT, 0).alias("unit")))
    yen = lambda key: F.filter(found(F.substring("_norm", F.instr("_norm", key), F.lit(len(key) + window))), lambda x: x["n"].isNotNull() & (x["unit"] == "円"))
    df = df.withColumns({f"_yen{i}": F.when(F.instr("_norm", key) > 0, yen(key)) for i, key in enumerate(DIVIDENDS)})
    moves = F.array_compact(F.array(*(F.signum(F.get(f"_yen{i}", F.lit(1))["n"] - F.get(f"_yen{i}", F.lit(0))["n"]) for i in range(len(DIVIDENDS)))))
    first = F.get(F.filter(moves, lambda m: m != 0), F.lit(0))
    return df.withColumn(name, F.when(first > 0, "positive").when(first < 0, "negative").otherwise("unknown")).drop("_norm", *(f"_yen{i}" for i in range(len(DIVIDENDS))))


def with_extraordinary_items(df: DataFrame, text: str, name: str, window: int = 100, weight: float = 2.0) -> DataFrame:
    """df with the side of extraordinary items: the sums of the first amounts behind every mention of losses and of gains; one `weight` times the other decides."""
    amounts = r"([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?)\s*(" + UNIT + ")"
    df = df.withColumn("_norm", plain_figure(F.col(text)))

    def total(keys: list[str]) -> Column:
        behind = F.concat(*(F.regexp_extract_all("_norm", F.lit(rf"{key}(?=([\s\S]{{0,{window}}}))"), F.lit(1)) for key in keys))
        yen = F.transform(behind, lambda s: F.coalesce(figure(F.regexp_extract(s, amounts, 1)) * unit_factor(F.regexp_extract(s, amounts, 2)), F.lit(0.0)))
        return F.aggregate(yen, F.lit(0.0), lambda a, x: a + x)

    df = df.withColumns({"_loss": total(LOSSES), "_gain": total(GAINS)})
    loss, gain = F.col("_loss"), F.col("_gain")
    side = F.when((loss > 0) | (gain > 0), F.when(loss >= weight * gain, "negative").when(gain >= weight * loss, "positive").otherwise("mixed")).otherwise("unknown")
    return df.withColumn(name, side).drop("_norm", "_loss", "_gain")
