"""Variant spellings of names of people and organisations, linked by a set-similarity join on token q-grams.

1. Names are reduced to distinct texts and cut into tokens (folded, split at case changes; titles, articles and
   legal forms dropped). A token weighs as much as it is rare among the names.
2. Tokens that one typing slip may separate are found by a prefix-filtered join: q-grams are ordered by rarity,
   and of each token only the ``PREFIX`` rarest enter the join; one slip touches at most four q-grams, so two such
   tokens share one of them (tokens of up to five letters meet on their one-letter deletions instead).
3. Candidates are all pairs in which the heaviest token of each name, or one slip of it, occurs in the other, and
   names of the same letters. No token is too frequent to count.
4. Candidates are verified by soft weighted token similarity: tokens match if equal, one slip apart, nickname,
   abbreviation or initial; rare tokens count more, and the rarest of each name has to match; what is left over on
   both sides is a contradiction. A pair that says the same in full is a strong link; a name that says less than
   the other (dropped words, initials, nicknames) is a weak one.
5. Strong links form classes by propagation of the smallest label, cut by checkpoints. A class of short forms may
   fit several classes that contradict each other; it joins only the one with most names.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomstrata.session import cut

Q, PREFIX = 3, 5
#: A token of this share of the names, and of this many at least, is a common word, which others may abbreviate.
COMMON_SHARE, COMMON_LEAST = 0.005, 12
#: Legal forms, articles and titles, which tell no parties apart.
LEGAL = frozenset(
    "ltd limited llc inc incorporated corp corporation co company gmbh gesellschaft mbh ag aktiengesellschaft ab aktiebolag sa ev plc kg ohg bv nv oy as srl spa sarl pty"
    " societe anonyme eingetragener verein the and of fur und et dr prof mr mrs ms herr frau".split()
)
#: Units of an organisation after " - ".
UNITS = frozenset("ospo release team product security department".split())
#: Common nicknames of given names in English, German and some other languages.
NICKNAMES = {
    "abigail": "abby gail", "albert": "al bert bertie", "alexander": "alex sasha sascha xander", "alexandra": "alex sandra sasha lexi", "alfred": "alf alfie fred", "amanda": "mandy", "andrew": "andy drew", "andreas": "andi andy",
    "anneliese": "anne anni liese lisa annie", "anthony": "tony", "barbara": "barb babs bärbel", "bartholomew": "bart", "benjamin": "ben benny benji", "bernhard": "bernd", "catherine": "cathy kate cat", "charles": "charlie chuck chas",
    "chiara": "kiki", "christina": "tina chris", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "debbie deb debby", "dorothy": "dot dolly", "edward": "ed eddie ted ned",
    "eleanor": "ellie nell nora", "elizabeth": "liz beth betty lizzie eliza lisa", "eugene": "gene", "francis": "frank fran", "franziska": "franzi", "frederick": "fred freddy freddie fritz", "friedrich": "fritz",
    "gabriela": "gabi gaby gabby", "gerald": "gerry jerry", "gregory": "greg", "heinrich": "heinz heini", "helena": "lena", "henry": "harry hank", "ingrid": "inga", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny",
    "johannes": "hannes hans jo johann", "jonathan": "jon", "joseph": "joe joey jo sepp", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie kat", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "leo len lenny",
    "ludwig": "lutz", "magdalena": "lena magda", "margaret": "maggie peggy meg greta marge", "martha": "marty", "matthew": "matt", "matthias": "matze matt matthes", "mehmet": "memo", "michael": "mike mick michi micha",
    "natalia": "natasha", "nathaniel": "nate nat", "nicholas": "nick nicky", "nikolaus": "nick klaus niko nikolas niklas nico", "olamide": "ola", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becky", "reinhard": "reini", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "rudolf": "rudi", "samantha": "sam",
    "samuel": "sam sammy", "sebastian": "basti seb", "stephen": "steve", "susanne": "susi susan sue sanne", "sylvester": "sly", "theodore": "ted teddy theo", "theresa": "tess teresa terry resi", "thomas": "tom tommy",
    "timothy": "tim timmy", "tomasz": "tomek tom", "ulrich": "uli ulli", "victoria": "vicky tori", "vincent": "vince vinny", "walter": "walt wally", "wilhelm": "willi wim", "william": "will bill billy liam willy", "wolfgang": "wolf wolfi",
}


@dataclass(frozen=True)
class Lexicon:
    """What is known of words beforehand. Each table is the caller's to replace; empty ones are allowed."""

    legal: frozenset = LEGAL
    units: frozenset = UNITS
    nicknames: tuple = tuple(NICKNAMES.items())

    @functools.cached_property
    def nicks(self) -> frozenset:
        """(nickname, name)"""
        return frozenset((fold(n), fold(k)) for k, v in self.nicknames for n in v.split())

    @functools.cached_property
    def given(self) -> frozenset:
        return frozenset(x for pair in self.nicks for x in pair)

    def nick(self, a: str, b: str) -> bool:
        return (a, b) in self.nicks or (b, a) in self.nicks


_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without diacritics."""
    t = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return "".join(c for c in t if not unicodedata.combining(c))


DEFAULT = Lexicon()


def tokens(name: str, lex: Lexicon = DEFAULT) -> list[str]:
    """Folded tokens in order of occurrence."""
    main, _, unit = name.partition(" - ")
    if unit and not set(re.findall(r"[^\W_]+", fold(unit))) <= lex.units:
        main = name
    main = re.sub(r"\b(?:[^\W\d_]\.\s?){2,}(?:[^\W\d_]\b)?", lambda m: " " if fold(re.sub(r"[.\s]", "", m[0])) in lex.legal else m[0], main)
    main = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", " ", main.replace("mbH", "mbh"))
    out = [t for t in re.findall(r"[^\W_]+", fold(main)) if t not in lex.legal]
    return out or re.findall(r"[^\W_]+", fold(name)) or [name.strip().lower()]


def slips(a: str, b: str) -> int:
    """Edits between two tokens, a swap of neighbours counted once; 2 stands for two or more."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return 2
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(la, lb) - i and a[la - 1 - j] == b[lb - 1 - j]:
        j += 1
    x, y = a[i : la - j], b[i : lb - j]
    return 1 if len(x) <= 1 and len(y) <= 1 or (len(x) == 2 and y == x[::-1]) else 2


def _plain(t: str) -> str:
    return t.replace("ae", "a").replace("oe", "o").replace("ue", "u")


@functools.lru_cache(maxsize=500_000)
def alike(a: str, b: str, lex: Lexicon = DEFAULT) -> float:
    """Similarity of two tokens in 0..1."""
    if a == b:
        return 1.0
    if lex.nick(a, b):
        return 0.95
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.85 if b[0] == a else 0.0
    if _plain(a) == _plain(b):
        return 1.0
    if b in (a + "and", a + "und"):
        return 1.0
    if len(a) >= 4 and slips(a, b) == 1 or len(b) <= 4 and len(a) >= 3 and slips(a, b) == 1:
        return 0.95
    if a[0] == b[0] and len(a) < len(b):
        it = iter(b)
        if all(c in it for c in a) and (len(a) <= 5 and len(b) - len(a) >= 2):
            return 0.9
    return 0.0


def short_for(a: str, b: str) -> bool:
    """Whether ``a`` looks like an abbreviation of ``b``."""
    it = iter(b)
    return 2 <= len(a) <= 5 and len(b) - len(a) >= 2 and a[0] == b[0] and all(c in it for c in a)


STRONG, A_SHORT, B_SHORT, EITHER = 3, 1, 2, 4


def relation(a: list[str], wa: list[float], b: list[str], wb: list[float], least: float, lex: Lexicon = DEFAULT) -> int:
    """0, or how two names belong together: strongly, or with one of them a short form of the other.

    ``wa``, ``wb``: weights of the tokens; negative for given names and for abbreviations of common words, which
    cannot carry a link.
    """
    if "".join(a) == "".join(b):
        return STRONG
    scored = sorted(((s, abs(wa[i]) + abs(wb[j]), -i, -j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := alike(x, y, lex)) > 0), reverse=True)
    top_a = max((w for t, w in zip(a, wa) if len(t) > 2), default=9e9)
    top_b = max((w for t, w in zip(b, wb) if len(t) > 2), default=9e9)
    left_a, left_b = set(range(len(a))), set(range(len(b)))
    got, key_a, key_b, short_a, short_b = 0.0, False, False, False, False
    for s, _, i, j in scored:
        i, j = -i, -j
        if i not in left_a or j not in left_b:
            continue
        x, y, u, v = a[i], b[j], abs(wa[i]), abs(wb[j])
        if (len(x) == 1 < len(y) and wb[j] >= top_b) or (len(y) == 1 < len(x) and wa[i] >= top_a):
            continue  # an initial never stands for what makes a name rare
        left_a.discard(i)
        left_b.discard(j)
        got += s * max(u, v) ** 2 if 1 in (len(x), len(y)) else s * (u * u + v * v) / 2
        if s >= 0.95 and not lex.nick(x, y):
            key_a |= wa[i] >= top_a
            key_b |= wb[j] >= top_b
        if slips(x, y) < 2 and len(x) > 1 and len(y) > 1:
            continue
        short_a |= len(x) == 1 < len(y) or (x, y) in lex.nicks
        short_b |= len(y) == 1 < len(x) or (y, x) in lex.nicks
    if not (key_a and key_b) or (left_a and left_b):
        return 0
    all_a, all_b = got + sum(wa[i] ** 2 for i in left_a), got + sum(wb[j] ** 2 for j in left_b)
    if got / math.sqrt(all_a * all_b) < least:
        return 0
    short_a |= any(len(b[j]) > 1 for j in left_b)
    short_b |= any(len(a[i]) > 1 for i in left_a)
    if not short_a and not short_b:
        short_a, short_b = bool(left_b), bool(left_a)
    return EITHER if short_a and short_b else A_SHORT if short_a else B_SHORT if short_b else STRONG


def party_names(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct names: what follows ``Organization:`` or ``Person:``, without a closing parenthesis group, trimmed."""
    each = df.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("v"))
    name = F.regexp_extract("v", r"(?s)^(?:Organization|Person):(.*)$", 1)
    space = r"[\s\u0085  -     　]"
    name = F.regexp_replace(F.regexp_replace(name, rf"(?U)^{space}+|{space}+$", ""), r"\([^()]*\)$", "")
    name = F.regexp_replace(name, rf"(?U)^{space}+|{space}+$", "")
    return each.select(name.alias("name")).where(F.col("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def _tokenise(lex: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [tokens(x, lex) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t, pa.list_(pa.string()))], names=["name", "tokens"])

    return run


def _near_tokens(words: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of tokens that one slip may separate: prefix-filtered join on q-grams."""
    padded = F.concat(F.lit("^"), "token", F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - Q + 1, F.lit(1))), lambda i: F.substring(padded, i, Q)))
    g = words.where(F.length("token") >= 3).select("token", F.explode(grams).alias("gram"))
    freq = g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    prefix = g.join(freq, "gram").groupBy("token").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, PREFIX).alias("p"))  # a token has few q-grams
    p = prefix.select("token", F.explode("p.gram").alias("gram"))
    # a slip may touch all q-grams of a short token: those meet on what is left without one letter
    n = F.length("token")
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("~"), F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, n)))
    p = p.unionByName(words.where(n.between(3, 5)).select("token", F.explode(F.array_distinct(F.concat(less, F.array(F.concat(F.lit("~"), F.col("token")))))).alias("gram")))
    a, b = p.select(F.col("token").alias("a"), "gram"), p.select(F.col("token").alias("b"), "gram")
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1)
    same_letters = F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", ""))
    d = F.levenshtein("a", "b")
    return a.join(b, "gram").where(close).select("a", "b").distinct().where((d <= 1) | ((d == 2) & same_letters))


def _kin_tokens(words: DataFrame) -> DataFrame:
    """``token, key``: each token with itself and all tokens that ``alike`` can take for the same word (0.95 or more, nicknames aside)."""
    near = _near_tokens(words)
    plain = F.expr("replace(replace(replace(token, 'ae', 'a'), 'oe', 'o'), 'ue', 'u')")
    p = words.select("token", plain.alias("plain"))
    near = near.unionByName(p.select(F.col("token").alias("a"), "plain").join(p.select(F.col("token").alias("b"), "plain"), "plain").where("a < b").select("a", "b"))
    longer = words.where(F.col("token").rlike("^.+[au]nd$")).select(F.expr("left(token, length(token) - 3)").alias("a"), F.col("token").alias("b"))
    near = near.unionByName(longer.join(words.select(F.col("token").alias("a")), "a", "left_semi"))
    both = near.select(F.col("a").alias("token"), F.col("b").alias("key")).unionByName(near.select(F.col("b").alias("token"), F.col("a").alias("key")))
    return both.unionByName(words.select("token", F.col("token").alias("key"))).distinct()


def candidates(info: DataFrame) -> DataFrame:
    """``name_a, name_b``, ``name_a < name_b``: every pair that ``relation`` can accept (``info``: name, tokens, weights).

    It accepts equal letters, or pairs in which the heaviest token of each name meets a token of the other. So a name
    is looked up by pairs (its heaviest token, any of its tokens) among the pairs (any token, heaviest token) of the
    others. Frequent tokens take part like others: a common word alone brings nothing together.
    """
    words = cut(info.select("name", F.explode(F.arrays_zip("tokens", "weights")).alias("t"), F.expr("array_max(transform(filter(arrays_zip(tokens, weights), t -> length(t.tokens) > 2), t -> t.weights))").alias("top")).select("name", F.col("t.tokens").alias("token"), (F.col("t.weights") >= F.coalesce("top", F.lit(9e9))).alias("heavy")).distinct())
    kin = cut(_kin_tokens(words.select("token").distinct()))
    heavy = words.where("heavy")
    wide = words.join(kin, "token").select("name", "key", "heavy")
    left = wide.where("heavy").select("name", F.col("key").alias("k")).join(wide.select("name", F.col("key").alias("s")), "name").select(F.col("name").alias("name_a"), "k", "s").distinct()
    right = words.select("name", F.col("token").alias("k")).join(heavy.select("name", F.col("token").alias("s")), "name").select(F.col("name").alias("name_b"), "k", "s")
    pairs = left.join(right, ["k", "s"]).where("name_a < name_b").select("name_a", "name_b")
    whole = info.select("name", F.array_join("tokens", "").alias("k"))
    return pairs.unionByName(whole.withColumnRenamed("name", "name_a").join(whole.withColumnRenamed("name", "name_b"), "k").where("name_a < name_b").select("name_a", "name_b")).distinct()


def link_names(names: DataFrame, least: float = 0.6, lex: Lexicon = DEFAULT) -> DataFrame:
    """``name_a, name_b, kind``: pairs of distinct names (``names``: name) that the similarity verifies.

    Pairs are between similar texts, not yet closed over classes. Null and empty names give nothing; a single name
    gives nothing; repeated names count once; very long names are tokens like others.
    """
    spark = names.sparkSession
    base = cut(names.select("name").where(F.col("name").isNotNull() & (F.col("name") != "")).distinct().mapInArrow(_tokenise(lex), "name string, tokens array<string>"))
    n = base.count()
    if n < 2:
        return spark.createDataFrame([], "name_a string, name_b string, kind int")
    words = base.select("name", F.explode(F.array_distinct("tokens")).alias("token"))
    df = cut(words.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    total = math.log(n + 1)
    # the tokens of a share are at most the tokens of a name over that share, however many names there are
    common = [r["token"] for r in df.where(F.col("df") > max(COMMON_LEAST, COMMON_SHARE * n)).select("token").collect()]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weight(token: str, d: int) -> float:
            w = max(0.05, total - math.log(d))
            return -w if token in lex.given or (len(token) <= 5 and any(short_for(token, c) for c in common)) else w

        for b in batches:
            w = list(map(weight, b.column("token").to_pylist(), b.column("df").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("token"), pa.array(w, pa.float64())], names=["token", "weight"])

    weights = df.select("token", "df").mapInArrow(weigh, "token string, weight double")
    of_name = words.join(weights, "token").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("w"))  # tokens of one name
    info = cut(base.join(of_name, "name").select("name", "tokens", F.transform("tokens", lambda t: F.try_element_at("w", t)).alias("weights")))
    side = lambda x: info.select(F.col("name").alias(f"name_{x}"), F.col("tokens").alias(f"t{x}"), F.col("weights").alias(f"w{x}"))
    rich = candidates(info).join(side("a"), "name_a").join(side("b"), "name_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.to_pydict()
            kind = [relation(ta, wa, tb, wb, least, lex) for ta, wa, tb, wb in zip(cols["ta"], cols["wa"], cols["tb"], cols["wb"])]
            out = pa.RecordBatch.from_arrays([b.column("name_a"), b.column("name_b"), pa.array(kind, pa.int32())], names=["name_a", "name_b", "kind"])
            yield out.filter(pa.array([k > 0 for k in kind], pa.bool_()))

    return rich.select("name_a", "name_b", "ta", "wa", "tb", "wb").mapInArrow(verify, "name_a string, name_b string, kind int")


def components(links: DataFrame) -> DataFrame:
    """``name, class``: names of linked pairs with the smallest name they are linked to, directly or not."""
    both = cut(links.select(F.col("name_a").alias("name"), F.col("name_b").alias("other")).unionByName(links.select(F.col("name_b").alias("name"), F.col("name_a").alias("other"))))
    label = cut(both.groupBy("name").agg(F.min("other").alias("m")).select("name", F.least("name", "m").alias("class")))
    while True:
        near = both.join(label.withColumnRenamed("name", "other"), "other").groupBy("name").agg(F.min("class").alias("m"))
        step = label.join(near, "name", "left").select("name", "class", F.least("class", F.coalesce("m", "class")).alias("next"))
        jump = step.join(label.select(F.col("name").alias("next"), F.col("class").alias("root")), "next", "left").select("name", "class", F.least("next", F.coalesce("root", "next")).alias("next"))
        jump = cut(jump)
        if jump.where(F.col("next") != F.col("class")).isEmpty():
            return jump.select("name", F.col("next").alias("class"))
        label = jump.select("name", F.col("next").alias("class"))


def _weak_links(links: DataFrame, label: DataFrame) -> DataFrame:
    """``s, t, from, to``: names that say less (``s``) than others (``t``), and the classes of both."""
    a, b = F.struct(F.col("name_a").alias("s"), F.col("name_b").alias("t")), F.struct(F.col("name_b").alias("s"), F.col("name_a").alias("t"))
    weak = links.where(F.col("kind") != STRONG).select(F.explode(F.when(F.col("kind") == A_SHORT, F.array(a)).when(F.col("kind") == B_SHORT, F.array(b)).otherwise(F.array(a, b))).alias("x")).select("x.s", "x.t")
    return weak.join(label.select(F.col("name").alias("s"), F.col("class").alias("from")), "s").join(label.select(F.col("name").alias("t"), F.col("class").alias("to")), "t").where(F.col("from") != F.col("to"))


def class_links(names: DataFrame, links: DataFrame) -> DataFrame:
    """``class_a, class_b, n_links``: verified links between names of different classes, all of them.

    A short form that fits several parties joins one class only (``classes``); what else it fits is told here.
    """
    of = names.select("name").join(classes(names, links), "name", "left").select("name", F.coalesce("class", "name").alias("class"))
    side = lambda x: of.select(F.col("name").alias(f"name_{x}"), F.col("class").alias(f"class_{x}"))
    d = links.join(side("a"), "name_a").join(side("b"), "name_b").where(F.col("class_a") != F.col("class_b"))
    return d.groupBy(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).agg(F.count(F.lit(1)).alias("n_links"))


def classes(names: DataFrame, links: DataFrame) -> DataFrame:
    """``name, class``: linked names with the label of their class."""
    strong = components(links.where(F.col("kind") == STRONG))
    label = names.select("name").join(strong, "name", "left").select("name", F.coalesce("class", "name").alias("class"))
    label = cut(label)
    size = label.join(names, "name").groupBy("class").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows")).alias("size"))
    weak = _weak_links(links, label)
    weak = weak.join(size.withColumnRenamed("class", "to"), "to")
    best = weak.groupBy("from").agg(F.max(F.struct("size.n", "size.rows", "to")).alias("m")).select(F.col("from").alias("name_a"), F.col("m.to").alias("name_b"))
    joined = components(best).select(F.col("class").alias("root"), F.col("name").alias("class"))
    out = label.join(joined, "class", "left").select("name", F.coalesce("root", "class").alias("class"))
    several = out.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")
    return out.join(several, "class", "left_semi").select("name", "class")


def same_party(df: DataFrame, columns: list[str]) -> DataFrame:
    """``name_a, name_b``, ``name_a < name_b`` by code points: all pairs within the classes of linked names."""
    names = cut(party_names(df, columns))
    c = cut(classes(names, cut(link_names(names))))
    return c.select(F.col("name").alias("name_a"), "class").join(c.select(F.col("name").alias("name_b"), "class"), "class").where("name_a < name_b").select("name_a", "name_b")


def party_classes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per linked name: its class and number of links."""
    names = cut(party_names(df, columns))
    links = cut(link_names(names))
    n = links.select(F.explode(F.array("name_a", "name_b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_links"))
    return classes(names, links).join(n, "name")


def party_links(df: DataFrame, columns: list[str]) -> DataFrame:
    """Links between parties that are not one class."""
    names = cut(party_names(df, columns))
    return class_links(names, cut(link_names(names)))
