"""People under several names: Hangul names in Latin letters (inventory M24) and upkeep of the alias table (M26)."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.registry import frame

# Usual spellings of family names.
SURNAMES = {
    "김": "kim gim", "이": "lee yi rhee lie i", "박": "park pak bak", "최": "choi choe chey", "정": "jung jeong chung joung",
    "조": "cho jo joe", "강": "kang gang", "윤": "yoon yun", "장": "jang chang", "임": "lim im rim", "한": "han",
    "오": "oh o", "서": "seo suh so", "신": "shin sin", "권": "kwon gwon", "황": "hwang", "안": "ahn an",
    "송": "song", "류": "ryu yoo yu", "유": "yoo yu you", "홍": "hong", "전": "jeon jun chun", "고": "ko go koh",
    "문": "moon mun", "양": "yang", "손": "son sohn", "배": "bae bai", "백": "baek paek baik", "허": "heo huh hur",
    "남": "nam", "노": "noh no roh", "하": "ha", "곽": "kwak gwak", "성": "sung seong", "차": "cha",
    "주": "joo ju chu", "우": "woo u", "구": "koo gu ku", "민": "min", "나": "na ra", "진": "jin chin",
    "지": "ji chi", "엄": "um eom", "채": "chae", "원": "won", "천": "chun cheon", "방": "bang", "공": "kong gong",
    "현": "hyun hyeon", "함": "ham", "변": "byun byeon", "염": "yeom yum", "여": "yeo yuh", "추": "choo chu",
    "도": "do doh", "소": "so", "석": "seok suk", "선": "sun seon", "설": "seol sul", "마": "ma", "길": "gil kil",
    "연": "yeon yun", "위": "wi wee", "표": "pyo", "명": "myung myeong", "기": "ki gi", "반": "ban", "왕": "wang",
    "금": "keum geum", "옥": "ok", "육": "yook yuk", "인": "in", "맹": "maeng", "제": "je", "모": "mo",
    "탁": "tak", "국": "kook guk", "은": "eun", "편": "pyun pyeon", "용": "yong", "예": "ye", "경": "kyung gyeong",
    "봉": "bong", "사": "sa", "부": "boo bu", "태": "tae", "목": "mok", "형": "hyung hyeong", "두": "doo du",
    "동": "dong", "호": "ho", "승": "seung", "상": "sang", "시": "si", "단": "dan",
}
# Family names so common that their spelling alone says nothing.
COMMON = "김이박최정조강윤장임한오서신권황안송류유홍전고문양손배백허남노하곽성차주우구민나진지"
# Spellings of the first, middle and last letters of a syllable, in the order of their code points.
FIRST = ["g k", "kk", "n", "d t", "tt", "r l", "m", "b p", "pp", "s", "ss", "", "j ch", "jj", "ch", "k", "t", "p", "h"]
MIDDLE = ["a", "ae", "ya", "yae", "eo u o", "e", "yeo yu yo", "ye", "o oh", "wa", "wae", "oe oi", "yo", "u oo", "wo", "we", "wi", "yu yoo", "eu u", "ui eui", "i ee y"]
LAST = ["", "k g", "kk k", "k", "n", "n", "n", "t d", "l r", "k", "m", "l", "l", "l", "p", "l", "m", "p b", "p", "t s", "t", "ng", "t", "t", "k", "t", "p", "t"]

#: Points of each kind of evidence.
POINTS = {"full": 5, "part": 3, "initials": 2}
_HANGUL = re.compile("[가-힣]{2,4}")
_COMMON_SPELLINGS = {s for name in COMMON for s in SURNAMES[name].split()}


def _letters(syllable: str) -> tuple[list[str], list[str], list[str]]:
    first, rest = divmod(ord(syllable) - 0xAC00, 588)
    middle, last = divmod(rest, 28)
    return FIRST[first].split(" "), MIDDLE[middle].split(" "), LAST[last].split(" ")


def _spelled(syllable: str) -> set[str]:
    return {"".join(x) for x in product(*_letters(syllable))}


def _initials(syllable: str) -> set[str]:
    first, middle, _ = _letters(syllable)
    return {x[0] for x in first if x} or {x[0] for x in middle}


def _joined(*sets: set[str]) -> set[str]:
    return {"".join(x) for x in product(*sets)}


def spellings(name: str | None) -> list[tuple[str, str]]:
    """(letters, evidence) of every way in which a Hangul name of two to four syllables is met in Latin letters; other names have none.

    full: family and given name, either first. part: these, the given name, its first syllable, also with the family name, and initials of
    the given name with the family name; at least three letters, and not a common family name alone. initials: of all names.
    """
    if not _HANGUL.fullmatch(name or ""):
        return []
    family = set(SURNAMES[name[0]].split()) if name[0] in SURNAMES else _spelled(name[0])
    given, start = _joined(*map(_spelled, name[1:])), _spelled(name[1])
    short = _joined(*map(_initials, name[1:]))
    full = _joined(family, given) | _joined(given, family)
    part = full | given | start
    for some in (start, short):
        part |= _joined(family, some) | _joined(some, family)
    initials = _joined({x[0] for x in family}, short) if name[0] in SURNAMES else set()
    out = [(x, "full") for x in full]
    out += [(x, "part") for x in part if len(x) >= 3 and x not in _COMMON_SPELLINGS]
    return out + [(x, "initials") for x in initials if len(x) >= 3]


def name_pairs(names: DataFrame, handles: DataFrame) -> DataFrame:
    """name, handle, evidence, points: the best evidence that a handle is a name's Latin form.

    Names are spelled out and met by equal letters, so names and handles are never paired with each other in full: a name of four
    syllables has some ten thousand spellings at most, one of three some hundred. A handle of words of letters alone is met in full (one
    word of under six letters is too common); a handle of one word, its digits and signs left out, also in part and by initials. A handle
    goes to the names of its best evidence, but where that is only part or initials and several names share it, to none. Nulls and repeated rows count once.
    """
    spell = F.udf(spellings, "array<struct<letters:string,evidence:string>>")
    spelled = names.select("name").distinct().select("name", F.explode(spell("name")).alias("s")).select("name", "s.letters", "s.evidence")
    words = F.filter(F.split(F.lower("handle"), r"[\s\-_.,]+"), lambda w: w != "")
    asked = handles.select("handle").where("handle IS NOT NULL").distinct().select("handle", words.alias("words"))
    asked = asked.select("handle", F.size("words").alias("n"), F.array_join("words", "").alias("flat"))
    pure = F.col("flat").rlike("^[a-z]+$")
    asked = asked.select("handle", "n", pure.alias("pure"), F.regexp_replace("flat", "[^a-z]", "").alias("letters"))
    whole = F.col("pure") & ((F.col("n") >= 2) | (F.length("letters") >= 6))
    points = F.create_map(*(F.lit(x) for pair in POINTS.items() for x in pair))
    met = asked.join(spelled, "letters").where(F.when(F.col("evidence") == "full", whole).otherwise(F.col("n") == 1))
    best = met.groupBy("name", "handle").agg(F.max(points[F.col("evidence")]).alias("points"))
    # Names that share a handle are counted, never gathered.
    ranks = best.groupBy("handle", "points").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    lone = ranks.groupBy("handle").agg(F.max_by(F.struct("n", "name"), "points").alias("top"), F.max("points").alias("points")).where("top.n = 1")
    kept = best.where(F.col("points") == POINTS["full"]).unionByName(lone.where(F.col("points") < POINTS["full"]).select(F.col("top.name").alias("name"), "handle", "points"))
    evidence = F.create_map(*(F.lit(x) for kind, n in POINTS.items() for x in (n, kind)))
    return kept.select("name", "handle", evidence[F.col("points")].alias("evidence"), "points")


def upkeep(aliases: DataFrame, rejected: DataFrame, actions: DataFrame) -> DataFrame:
    """alias, name, state (`approved` or `rejected`) after actions (seq, op, alias, name) in the order of seq.

    `approve` moves the alias to the name and takes back a rejection of the pair; `reject` notes the pair, and takes the alias off that
    name; `remove` takes the alias off whoever has it. Aliases are trimmed and lower-cased, names trimmed; an action without the ones it
    needs does nothing. All actions are folded at once, by aggregates per alias and per pair.
    """
    tidy = lambda df, *more: df.select(*more, F.lower(F.trim("alias")).alias("alias"), F.trim("name").alias("name")).where("alias <> ''")
    start = lambda df, op: tidy(df.withColumn("seq", F.lit(-1).cast("long")).withColumn("op", F.lit(op)), "seq", "op")
    done = tidy(actions.withColumn("seq", F.col("seq").cast("long")), "seq", "op").where("op = 'remove' OR name <> ''")
    log = start(aliases, "approve").unionByName(done)
    last = log.where("op = 'approve'").groupBy("alias").agg(F.max_by(F.struct("seq", "name"), F.struct("seq", "name")).alias("own"))
    off = log.join(last, "alias").where("seq > own.seq AND (op = 'remove' OR op = 'reject' AND name = own.name)").select("alias").distinct()
    kept = last.join(off, "alias", "left_anti").select("alias", F.col("own.name").alias("name"), F.lit("approved").alias("state"))
    pairs = start(rejected, "reject").unionByName(done.where("op <> 'remove'")).groupBy("alias", "name").agg(F.max_by("op", "seq").alias("op"))
    return kept.unionByName(pairs.where("op = 'reject'").select("alias", "name", F.lit("rejected").alias("state")))


@frame()
def name_match(spark, d):
    """Customers under Hangul names made of their number, met with suppliers' accounts made of theirs."""
    families, given = F.array(*(F.lit(x) for x in "김이박최정조강윤")), F.array(*(F.lit(x) for x in "강래봉수성영민호우선"))
    at = lambda a, k, n: F.element_at(a, ((k % n) + 1).cast("int"))
    k = F.col("c_custkey")
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(at(families, k, 8), at(given, F.floor(k / 8), 10), at(given, F.floor(k / 80), 10)).alias("name"))
    latin, first = F.array(*(F.lit(x) for x in "kim lee park choi jung cho kang yoon".split())), F.array(*(F.lit(x) for x in "kang rae bong soo sung young min ho woo sun".split()))
    s = F.col("s_suppkey")
    handle = F.when(s % 2 == 0, F.concat_ws("-", at(latin, s, 8), at(first, F.floor(s / 8), 10), at(first, s, 10))).otherwise(F.concat(at(first, F.floor(s / 3), 10), at(latin, s, 8), s.cast("string")))
    return name_pairs(names, spark.read.parquet(f"{d}/supplier.parquet").select(handle.alias("handle")))


@frame(
    """WITH RECURSIVE a AS (SELECT row_number() OVER (PARTITION BY user_id % 500 ORDER BY event_id) AS k, user_id % 500 AS g, event_id,
 concat('u', CAST(user_id % 500 AS VARCHAR)) AS alias, concat('n', CAST(event_id % 3 AS VARCHAR)) AS name,
 CASE WHEN event_id % 5 < 3 THEN 'approve' WHEN event_id % 5 = 3 THEN 'reject' ELSE 'remove' END AS op FROM events),
s AS (SELECT g, 0::BIGINT AS k, CAST(NULL AS VARCHAR) AS own, CAST([] AS VARCHAR[]) AS off FROM (SELECT DISTINCT g FROM a) UNION ALL
 SELECT a.g, a.k, CASE a.op WHEN 'approve' THEN a.name WHEN 'remove' THEN NULL ELSE CASE WHEN own = a.name THEN NULL ELSE own END END,
 CASE a.op WHEN 'approve' THEN list_filter(off, lambda x: x <> a.name) WHEN 'reject' THEN list_distinct(list_append(off, a.name)) ELSE off END
 FROM s JOIN a ON a.g = s.g AND a.k = s.k + 1),
e AS (SELECT concat('u', CAST(g AS VARCHAR)) AS alias, arg_max(coalesce(own, ''), k) AS own, arg_max(off, k) AS off FROM s GROUP BY g)
SELECT alias, own AS name, 'approved' AS state FROM e WHERE own <> '' UNION ALL SELECT alias, unnest(off), 'rejected' FROM e"""
)
def alias_upkeep(spark, d):
    """Events as actions on aliases, in the order of their ids; the oracle replays them one by one."""
    op = F.when(F.col("event_id") % 5 < 3, "approve").when(F.col("event_id") % 5 == 3, "reject").otherwise("remove")
    alias, name = (F.concat(F.lit(p), (F.col(c) % n).cast("string")) for p, c, n in (("u", "user_id", 500), ("n", "event_id", 3)))
    actions = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), op.alias("op"), alias.alias("alias"), name.alias("name"))
    empty = spark.createDataFrame([], "alias string, name string")
    return upkeep(empty, empty, actions)
