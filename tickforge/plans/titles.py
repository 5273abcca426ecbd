"""Disclosure titles and texts, put together from parts by row: tags, types, terms, dates, sides and what judges them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions import japanese as jp
from tickforge.functions import passages as ps
from tickforge.plans.registry import query
from tickforge.sources.tables import spread, table

#: Parts of titles as written, and in compatibility form where that is another.
HEADS = [("", ""), ("２０２４年３月期　", "2024年3月期 "), ("(訂正)", "(訂正)"), ("連結子会社の", "連結子会社の"), ("㈱テスト ", "(株)テスト ")]
SUBJECTS = [
    ("業績予想", ""), ("通期業績予想の上方修正", ""), ("配当予想", ""), ("株式分割（１株を３株）", "株式分割(1株を3株)"), ("株式の分割", ""), ("株式併合（１０株につき１株）", "株式併合(10株につき1株)"), ("上場廃止", ""), ("新規上場", ""), ("自己株式", ""), ("自己株式の取得", ""), ("株主優待制度", ""),
    ("決算短信", ""), ("月次情報", ""), ("売上高", ""), ("特別損失", ""), ("有価証券報告書", ""), ("四半期報告書", ""), ("大量保有報告書", ""), ("新株予約権", ""), ("完全子会社化に伴う上場廃止", ""), ("上場廃止に係る猶予期間入り", ""), ("株主還元方針", ""), ("株式併合", ""),
]
LINKS = [("", ""), ("及び", ""), ("に伴う", ""), ("と", "")]
OBJECTS = [
    ("", ""), ("の修正", ""), ("増配", ""), ("減配", ""), ("立会外買付", ""), ("取得状況", ""), ("ＴｏＳＴＮｅＴ－３による買付", "ToSTNeT-3による買付"), ("速報", ""), ("概況", ""), ("の中止", ""), ("ＴＯＢ", "TOB"), ("配当方針の変更", ""), ("効力発生日 ２０２６年４月１日", "効力発生日 2026年4月1日"),
    ("２対１株", "2対1株"), ("比率５：１", "比率5:1"), ("効力発生（2025年2月30日）", "効力発生(2025年2月30日)"), ("下振れ", ""), ("配当予想の修正", ""), ("０株を２株", "0株を2株"),
]
PARTS = [(HEADS, "p_size % 5"), (SUBJECTS, f"p_partkey % {len(SUBJECTS)}"), (LINKS, "(p_partkey + p_size) % 4"), (OBJECTS, f"(p_partkey + p_size * 3) % {len(OBJECTS)}")]


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _title_sql(plain: bool) -> str:
    return " || ".join(f"([{_list([(p or w) if plain else w for w, p in parts])}])[CAST({i} AS INT) + 1]" for parts, i in PARTS) + " || 'に関するお知らせ'"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, title): a title for each part."""
    pieces = [F.element_at(F.array(*(F.lit(w) for w, _ in parts)), F.expr(f"CAST({i} AS INT) + 1")) for parts, i in PARTS]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(*pieces, F.lit("に関するお知らせ")).alias("title"))


TITLES_SQL = f"t AS (SELECT p_partkey AS k, {_title_sql(False)} AS title, {_title_sql(True)} AS plain FROM part)"
# The rules of the tags again, as patterns: (tag, pattern that must match, second pattern, pattern that must not).
_RULES = [
    ("上方修正", "上方修正|上振れ", "", "下方修正"), ("下方修正", "下方修正|下振れ", "", ""), ("増配", "増配", "", ""), ("減配・無配", "減配|無配", "", ""), ("配当政策の変更", "配当方針|配当政策|株主還元方針|累進配当|配当性向|株主還元の方針", "変更|見直し|改定|導入|決定|方針|策定", ""),
    ("自社株買い", "自己株式の取得|自社株買い|自己株式取得|自己株式.*(立会外買付|ToSTNeT|取得状況)|(立会外買付|ToSTNeT|取得状況).*自己株式", "", ""), ("自己株式の消却", "自己株式の?消却", "", ""), ("配当(決定・予想)", "配当予想|剰余金の配当|配当の予想|配当金|復配|記念配当|特別配当", "", ""),
    ("業績予想の修正", "業績予想|通期予想", "修正|変更", "上方修正|下方修正"), ("決算短信", "決算短信", "", ""), ("特別損益", "特別損失|特別利益|特損|減損損失|減損の計上", "", ""), ("株式分割・併合", "株式分割|株式併合", "", ""), ("エクイティファイナンス", "公募増資|第三者割当|新株式発行|募集株式|新株予約権|転換社債|ライツ・オファリング|売出し|株式売出", "", ""),
    ("自己株式の処分", "自己株式の処分", "", ""), ("M&A・資本提携", "株式取得|子会社化|合併|事業譲渡|資本業務提携|資本提携|公開買付|TOB|株式交換|株式移転|連結子会社", "", ""), ("月次・速報", "月次|売上高.*(速報|概況)|(速報|概況).*売上高", "", ""), ("重要事象(調査等)", "特別調査委員会|第三者委員会|不適切|不正|行政処分|課徴金|業務改善命令|内部統制の不備", "", ""),
    ("上場・市場区分", "新規上場|上場廃止|市場区分の変更|市場変更|監理銘柄|整理銘柄|上場維持基準", "", ""), ("人事・組織", "代表取締役|役員人事|役員の異動|人事異動|組織変更|経営体制", "", ""), ("訂正・取消", "訂正|取消|取り消し", "", ""),
]
_TAGS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(plain, '{a}')" + (f" AND regexp_matches(plain, '{b}')" if b else "") + (f" AND NOT regexp_matches(plain, '{c}')" if c else "") + f" THEN '{tag}' END" for tag, a, b, c in _RULES) + "], lambda x: x IS NOT NULL)"
_GENUINE = lambda t: f"(NOT regexp_matches({t}, '該当しない|抵触しない|非該当|回避|おそれ|可能性|猶予|解除|解消|見送り|中止|撤回|優先株式|優先出資|種類株式|新株予約権付社債|優先証券') AND (contains({t}, '子会社化') OR NOT regexp_matches({t}, '子会社|孫会社|対象者|関連会社|持分法')) AND NOT (contains({t}, '修正') AND regexp_matches({t}, 'に伴う|に関連')))"
_HIGH = ["上方修正", "下方修正", "増配", "減配・無配", "配当政策の変更", "自社株買い", "自己株式の消却"]
TAGGED_SQL = f"{TITLES_SQL}, g AS (SELECT *, {_TAGS_SQL} AS tags FROM t), tagged AS (SELECT *, coalesce(list_filter(tags, lambda x: x IN ({_list(_HIGH)}))[1], tags[1]) AS primary_tag FROM g)"


@query(f"""WITH {TAGGED_SQL} SELECT k, array_to_string(tags, '|') AS tags, primary_tag, array_to_string(list_filter([CASE WHEN list_has_any(tags, ['下方修正', '減配・無配']) THEN 'negative' END, CASE WHEN list_has_any(tags, ['上方修正', '増配', '自社株買い', '自己株式の消却']) THEN 'positive' END], lambda x: x IS NOT NULL), '|') AS sides, {_GENUINE('title')} AS genuine FROM tagged""")
def title_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of disclosure titles, the one that colours them, the sides they take, and whether a listing event is the company's own."""
    rows = titles(spark, sf_dir).withColumn("found", jp.title_tags(ps.compatible("title")))
    return rows.select("k", F.array_join("found", "|").alias("tags"), jp.primary_tag(F.col("found")).alias("primary_tag"), F.array_join(jp.sentiments(F.col("found")), "|").alias("sides"), jp.genuine(F.col("title")).alias("genuine"))


_B = "[ \\t\u3000]*"
TERMS_SQL = f"""{TITLES_SQL}, n AS (SELECT *, translate(title, '０１２３４５６７８９：', '0123456789:') AS s FROM t), m AS (SELECT *, regexp_extract(s, '([0-9]+){_B}株?{_B}(?:を|につき|対|:){_B}([0-9]+){_B}株', ['a', 'b']) AS p, regexp_extract(s, '([0-9]+){_B}[:対]{_B}([0-9]+)', ['a', 'b']) AS q, regexp_extract(s, '効力発生日?[ \\t\u3000（(:：・,，。．をはがと/／]{{0,6}}([0-9]{{4}}){_B}年{_B}([0-9]{{1,2}}){_B}月{_B}([0-9]{{1,2}}){_B}日', ['y', 'm', 'd']) AS e FROM n),
terms AS (SELECT k, title, TRY_CAST(CASE WHEN p.a <> '' THEN p.a ELSE q.a END AS BIGINT) AS a, TRY_CAST(CASE WHEN p.a <> '' THEN p.b ELSE q.b END AS BIGINT) AS b, TRY_CAST(e.y || '-' || e.m || '-' || e.d AS DATE) AS day FROM m), x AS (SELECT *, a > 0 AND b > 0 AS whole FROM terms)"""


@query(f"""WITH {TERMS_SQL}, y AS (SELECT *, coalesce(whole, false) AS ok, regexp_matches(title, '業績予想.*修正|修正.*業績予想') AS f, regexp_matches(title, '配当.*修正|修正.*配当') AS d, {_GENUINE('title')} AS g FROM x),
z AS (SELECT *, CASE WHEN contains(title, '決算短信') THEN '短信' WHEN regexp_matches(title, '株式の?分割') AND (ok OR NOT (f OR d)) THEN '株式分割' WHEN regexp_matches(title, '株式の?併合') AND (ok OR NOT (f OR d)) THEN '株式併合' WHEN contains(title, '上場廃止') AND g THEN '上場廃止' WHEN contains(title, '新規上場') AND g THEN '新規上場' WHEN f THEN '業績修正' WHEN d THEN '配当修正' WHEN contains(title, '株主優待') THEN '優待'
  WHEN contains(title, '自己株式') AND contains(title, '取得') THEN '自社株買い' WHEN contains(title, '大量保有') THEN '大量保有' WHEN contains(title, '有価証券報告書') THEN '有報' WHEN contains(title, '四半期報告書') THEN '四半期報告' ELSE 'その他' END AS type FROM y)
SELECT k, type, CASE WHEN ok AND type IN ('株式分割', '株式併合') THEN a || ':' || b END AS terms, CASE WHEN ok AND type IN ('株式分割', '株式併合') THEN round(b / a, 6) END AS factor, CASE WHEN type IN ('株式分割', '株式併合', '上場廃止', '新規上場') THEN day END AS effective FROM z""")
def title_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of document of a title, and of corporate actions the terms and the effective date, where the title gives them."""
    rows = titles(spark, sf_dir).select("k", jp.document_type(F.col("title")).alias("type"), jp.split_terms(F.col("title")).alias("s"), jp.effective_date(F.col("title")).alias("day"))
    shares, action = F.col("type").isin("株式分割", "株式併合"), F.col("type").isin("株式分割", "株式併合", "上場廃止", "新規上場")
    return rows.select("k", "type", F.when(shares, F.col("s.terms")).alias("terms"), F.when(shares, F.round("s.factor", 6)).alias("factor"), F.when(action, F.col("day")).alias("effective"))


#: Texts of revisions: a key with two figures, a filler that may be longer than what is read behind a key, and another key.
KEYS = ["年間配当", "期末配当", "中間配当", "1株当たり配当金", "1株当たり配当金合計", "配当の方針"]
UNITS = ["円", "円", "銭", "百万円"]
ITEM_KEYS = ["特別損失", "減損損失", "特別利益", "特益", "特損", "売上高"]
AMOUNTS = ["百万円", "千円", "億円", "円", ""]


def _pick(values: list[str], i: str, spark_: bool) -> str:
    return f"element_at(array({_list(values)}), CAST({i} AS INT) + 1)" if spark_ else f"([{_list(values)}])[CAST({i} AS INT) + 1]"


def _dividend_text(spark_: bool) -> str:
    n = lambda x: f"CAST({x} AS STRING)" if spark_ else f"CAST({x} AS VARCHAR)"
    one = lambda key, a, b, unit: f"{_pick(KEYS, key, spark_)} || ' 前回予想 ' || {n(a)} || {_pick(UNITS, unit, spark_)} || ' 今回 ' || {n(b)} || {_pick(UNITS, unit, spark_)} || '。'"
    return one("p_partkey % 6", "p_size", "p_size + p_partkey % 3 - 1", "p_partkey % 4") + f" || repeat('　', CAST((p_size % 3) * 80 AS INT)) || " + one("p_size % 6", "p_partkey % 50", "p_size", "p_size % 4")


def _items_text(spark_: bool) -> str:
    n = lambda x: f"CAST({x} AS STRING)" if spark_ else f"CAST({x} AS VARCHAR)"
    one = lambda key, a, unit: f"{_pick(ITEM_KEYS, key, spark_)} || 'として ' || {n(a)} || {_pick(AMOUNTS, unit, spark_)} || ' を計上。'"
    return one("p_partkey % 6", "p_size * 7", "p_partkey % 5") + " || repeat('　', CAST((p_partkey % 3) * 60 AS INT)) || " + one("p_size % 6", "p_partkey % 90 + 1", "(p_size + p_partkey) % 5") + " || " + one("(p_size + p_partkey) % 6", "p_size", "0")


_FIGURES = "-?[ ]*[0-9]{1,3}(?:,[0-9]{3})*(?:[.][0-9]+)?[ ]*(?:百万円|千円|億円|兆円|円)?"
_YEN = {"百万円": "1e6", "千円": "1e3", "億円": "1e8", "兆円": "1e12", "円": "1"}


def _total_sql(keys: list[str]) -> str:
    """The sum of the first amounts behind every mention of each key; the stretches are cut where a mention begins."""
    each = lambda key: f"list_transform(string_split(items, '{key}')[2:], lambda s, i: regexp_extract(array_to_string(string_split(items, '{key}')[1 + i:], '{key}')[1:100], '([0-9]{{1,3}}(?:,[0-9]{{3}})*(?:[.][0-9]+)?)[ ]*(百万円|千円|億円|兆円|円)', ['n', 'u']))"
    value = "CASE WHEN m.n = '' THEN 0e0 ELSE CAST(replace(m.n, ',', '') AS DOUBLE) * CASE m.u " + " ".join(f"WHEN '{u}' THEN {x}" for u, x in _YEN.items()) + " END END"
    return "(" + " + ".join(f"coalesce(list_sum(list_transform({each(key)}, lambda m: {value})), 0)" for key in keys) + ")"


@query(f"""WITH x AS (SELECT p_partkey AS k, {_dividend_text(False)} AS dividend, {_items_text(False)} AS items FROM part),
y AS (SELECT k, key, i, [CAST(trim(regexp_extract(f, '-?[ ]*[0-9,.]+'), ' ') AS DOUBLE) FOR f IN regexp_extract_all(substr(dividend, strpos(dividend, key), len(key) + 160), '{_FIGURES}') IF regexp_matches(f, '[0-9][ ]*円$')] AS v FROM x, (SELECT unnest({jp.DIVIDENDS!r}) AS key, unnest(range({len(jp.DIVIDENDS)})) AS i) WHERE contains(dividend, key)),
d AS (SELECT k, arg_min(sign(v[2] - v[1]), i) FILTER (len(v) >= 2 AND v[2] <> v[1]) AS way FROM y GROUP BY k), s AS (SELECT k, {_total_sql(jp.LOSSES)} AS loss, {_total_sql(jp.GAINS)} AS gain FROM x)
SELECT x.k, CASE WHEN way > 0 THEN 'positive' WHEN way < 0 THEN 'negative' ELSE 'unknown' END AS dividend, CASE WHEN loss > 0 OR gain > 0 THEN CASE WHEN loss >= 2 * gain THEN 'negative' WHEN gain >= 2 * loss THEN 'positive' ELSE 'mixed' END ELSE 'unknown' END AS items FROM x LEFT JOIN d ON d.k = x.k LEFT JOIN s ON s.k = x.k""")
def disclosure_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of dividend revisions and of extraordinary items, read from their texts."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = part.select(F.col("p_partkey").alias("k"), F.expr(_dividend_text(True)).alias("text"), F.expr(_items_text(True)).alias("other"))
    return jp.with_extraordinary_items(jp.with_dividend_revision(rows, "text", "dividend"), "other", "items").select("k", "dividend", "items")


@query(f"""WITH {TAGGED_SQL}, b AS (SELECT tagged.*, CASE WHEN p_size % 9 = 0 THEN '  ' ELSE {_dividend_text(False)} END AS body FROM tagged JOIN part ON p_partkey = k)
SELECT k, CASE WHEN primary_tag IS NULL OR primary_tag NOT IN ({_list(list(jp.ENGINES))}) THEN 'skipped' WHEN trim(body) = '' THEN 'unknown' WHEN primary_tag = '業績予想の修正' THEN 'rule_v1_forecast' WHEN primary_tag = '配当(決定・予想)' THEN 'rule_v1_dividend' WHEN primary_tag = '特別損益' THEN 'rule_v1_extra' ELSE 'dict_v1' END AS engine FROM b""")
def sentiment_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What judges the text behind a title."""
    body = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 9 == 0, "  ").otherwise(F.expr(_dividend_text(True))).alias("body"))
    rows = titles(spark, sf_dir).withColumn("tag", jp.primary_tag(jp.title_tags(ps.compatible("title")))).join(body, "k")
    return rows.select("k", jp.engine(F.col("tag"), F.col("body")).alias("engine"))


#: Pieces of texts, as written and in normal form; blanks stand between them.
WORDS = ["ec", "saas", "リース", "ソース", "半導体"]
PIECES = [("ＥＣ　サイト", "ec サイト"), ("Tech Select™", "tech select"), ("ﾘｰｽ業", "リース業"), ("プレスリリース", "プレスリリース"), ("リ―ス", "リース"), ("オ‐トリ−ス", "オートリース"), ("経営リソース、ソース", "経営リソース、ソース"), ("A–B ～", "a-b -"), ("10―20", "10-20"), ("SaaS/EC・半導体製造", "saas/ec・半導体製造"), ("—ー—カー", "ーーーカー"), ("㈱", "(株)"), ("半導体Ⅲ", "半導体iii"), ("ecx", "ecx")]
PLACES = [f"p_partkey % {len(PIECES)}", f"(p_partkey + p_size) % {len(PIECES)}", f"(p_size * 5 + 3) % {len(PIECES)}"]


def _word_sql(word: str) -> str:
    kana = "[^゠-ヿㇰ-ㇿ]"
    ends = "[^a-z0-9]" if word.isascii() else kana if len(word) <= 4 and all("゠" <= c <= "ヿ" for c in word) else ""
    return f"CASE WHEN regexp_matches(' ' || normal || ' ', '{ends}{word}{ends}') THEN '{word}' END"


@query(f"WITH n AS (SELECT p_partkey AS k, {" || ' ' || ".join(_pick([p for _, p in PIECES], i, False) for i in PLACES)} AS normal FROM part) SELECT k, normal, array_to_string(list_filter([{', '.join(map(_word_sql, WORDS))}], lambda x: x IS NOT NULL), '|') AS words FROM n")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of texts and the words that stand for themselves in them."""
    pieces = [F.element_at(F.array(*(F.lit(w) for w, _ in PIECES)), F.expr(f"CAST({i} AS INT) + 1")) for i in PLACES]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), ps.normal(F.concat_ws("　 ", *pieces)).alias("normal"))
    return rows.select("k", "normal", F.array_join(ps.words_in(F.col("normal"), WORDS), "|").alias("words"))
