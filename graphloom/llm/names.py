"""Linking the spellings of persons and organisations.

Names are split into plain tokens.  A trie join finds the tokens within a few edits of one another:
tokens are sharded into tries by the ways to leave a letter out of their first, or last, four letters,
and a Levenshtein automaton with transpositions walks a shard's trie for all its tokens at once.  Rare
spellings take their most frequent neighbour's.  Then nicknames, abbreviations and initials are
resolved among the full names that stand beside the same surname, and names with the same tokens in
any order are one entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

TYPES = ("PERSON", "ORGANIZATION")
FUZZY_FROM, TWO_EDITS_FROM = 4, 8  # least letters of a token for one edit, and for two
SHORT, SHORT_TIMES = 4, 10  # tokens this short take a neighbour that is so many times as frequent only
PREFIX = 4
PARTNERS = 4  # different tokens beside a word of organisations that may be abbreviated
SHARD = 4000  # tokens of one trie and of one set of queries; larger shards are split both ways

# ---- Fixed values: word lists ----
TITLES = "prof professor dr doctor mr mrs ms miss mx sir dame lord lady herr frau mme mlle monsieur madame sr sra don dona rev hon jr ing mag phd md".split()
LEGAL = "inc incorporated ltd limited plc gmbh mbh llc llp lp corp corporation ag kg se sa sas sarl srl spa bv nv ab oy as pty the and of und et y de for hq headquarters".split()
NOTHING = "none null nan na n/a nil unknown unnamed unspecified undefined anonymous tbd various other".split()
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex alec sandy sasha xander", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny benji",
    "catherine": "cathy cat", "charles": "charlie chuck", "christina": "tina", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie",
    "dorothy": "dot dottie dolly dora", "edward": "ed eddie ned ted", "eleanor": "ellie nell nora nellie", "elizabeth": "liz beth betty lizzie eliza libby", "emily": "emmy", "francesca": "fran chesca frankie",
    "frederick": "fred freddie freddy", "gabriel": "gabe", "gregory": "greg", "harold": "harry hal", "henrietta": "etta hetty hettie", "henry": "hank", "ignatius": "iggy", "isabella": "bella izzy isa",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "jo josie fifi", "katherine": "kate kathy katie kit kitty",
    "lawrence": "larry laurie", "leonard": "len lenny leo", "margaret": "maggie peggy meg marge margie", "martin": "marty", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nat nate",
    "nicholas": "nick", "oliver": "ollie noll", "patricia": "pat trish patty tricia", "peter": "pete", "philip": "phil pip", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick richie",
    "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "stephen": "steve", "susannah": "sue susie suzy sukie", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmy",
    "ulrike": "ulla uli rike", "victoria": "vicky vic tori", "vincent": "vince vinnie vin", "walter": "walt", "william": "will bill billy willy liam", "yolanda": "yoli yola", "zachary": "zach zack zak",
}
# ---- End of fixed values ----

FORMAL_OF: dict[str, list[str]] = {}
for _formal, _short in NICKNAMES.items():
    for _s in _short.split():
        FORMAL_OF.setdefault(_s, []).append(_formal)
GIVEN = set(NICKNAMES) | set(FORMAL_OF)
#: Written abbreviations of listed names: three letters or more of the beginning, also with the last letter.
BRIEF = {n[:i] + end for n in NICKNAMES for i in range(3, len(n)) for end in ("", n[-1])} - set(NICKNAMES)
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.){2,}")
_WORD = re.compile(r"[^\W_]+")


def tokens(kind: str, text: str | None) -> list[str]:
    """Plain tokens of a name: lower case, without marks, titles and legal forms; none for marks that stand for nothing."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", (text or "").casefold()) if not unicodedata.combining(c))
    if flat.strip(" -?.*_/") in ("", *NOTHING):
        return []
    if kind == "ORGANIZATION":
        flat = _DOTTED.sub(lambda m: m.group(0).replace(".", "") + " ", flat)
    drop = TITLES if kind == "PERSON" else LEGAL
    found = _WORD.findall(flat)
    return [w for w in found if w not in drop] or found


def distance(a: str, b: str, most: int) -> int:
    """Edits, where two swapped neighbours are one; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most and (not before or min(old) > most):
            return most + 1
        before = old
    return row[-1]


def trie_join(queries: list[str], words: list[str], most: int = 2) -> list[tuple[str, str, int]]:
    """Every query with every other word within ``most`` edits.

    Queries are walked in order, so that the automaton's states of a common beginning are kept.
    """
    children: list[dict[str, int]] = [{}]
    ends: dict[int, str] = {}
    for w in words:
        at = 0
        for c in w:
            nxt = children[at].get(c)
            if nxt is None:
                nxt = children[at][c] = len(children)
                children.append({})
            at = nxt
        ends[at] = w

    def close(state: dict[int, int]) -> dict[int, int]:
        level = [n for n, d in state.items() if d < most]
        while level:
            following = []
            for n in level:
                d = state[n] + 1
                for m in children[n].values():
                    if state.get(m, most + 1) > d:
                        state[m] = d
                        if d < most:
                            following.append(m)
            level = following
        return state

    def step(last: dict[int, int], c: str, two_back: dict[int, int] | None, p: str) -> dict[int, int]:
        new: dict[int, int] = {}
        for n, d in last.items():
            if d < most:
                if new.get(n, most + 1) > d + 1:
                    new[n] = d + 1
                for x, m in children[n].items():
                    e = d if x == c else d + 1
                    if new.get(m, most + 1) > e:
                        new[m] = e
            else:
                m = children[n].get(c)
                if m is not None and new.get(m, most + 1) > d:
                    new[m] = d
        if two_back and p != c:
            for n, d in two_back.items():
                if d < most:
                    m = children[n].get(c)
                    m = children[m].get(p) if m is not None else None
                    if m is not None and new.get(m, most + 1) > d + 1:
                        new[m] = d + 1
        return close(new)

    out = []
    states = [close({0: 0})]
    before = ""
    for q in sorted(set(queries)):
        common = 0
        while common < min(len(q), len(before)) and q[common] == before[common]:
            common += 1
        del states[common + 1 :]
        for i in range(common, len(q)):
            states.append(step(states[-1], q[i], states[-2] if i else None, q[i - 1] if i else ""))
        before = q
        out += [(q, ends[n], d) for n, d in states[-1].items() if n in ends and ends[n] != q]
    return out


def _left_out(word: Column, end: str) -> Column:
    """The ways to leave a letter out of the first four letters, marked with the end that they are from."""
    head = F.substring(word, 1, PREFIX)
    return F.array_distinct(F.array(*[F.concat(F.lit(end), F.substring(head, 1, i), F.substring(head, i + 2, PREFIX)) for i in range(PREFIX)]))


def folded(word: Column) -> Column:
    """Spelling with letters of one sound made equal and doubled letters made single."""
    for old, new in (("ph", "f"), ("ck|c(?!h)|q", "k"), ("y", "i"), (r"(.)\1", "$1")):
        word = F.regexp_replace(word, old, new)
    return word


def neighbours(words: DataFrame) -> DataFrame:
    """type, token, other: tokens within one edit, or two if one of them has eight letters, or of one sound; both ways.

    ``words`` has type and token.  Two edits leave one half of a token with at most one, and then its
    outer four letters and the other's have a way of leaving out a letter in common.
    """
    long = words.filter(F.length("token") >= FUZZY_FROM).select("type", "token")
    keys = F.array_union(_left_out(F.col("token"), "<"), _left_out(F.reverse("token"), ">"))
    keyed = long.select("type", "token", F.explode(keys).alias("key"))
    blocks = keyed.groupBy("type", "key").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("_b")).join(keyed, ["type", "key"])
    own = F.pmod(F.xxhash64("token"), F.col("_b")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    one = blocks.filter("_b = 1").select("type", "key", F.lit(0).alias("q"), F.lit(0).alias("i"), F.lit("both").alias("side"), "token")
    many = blocks.filter("_b > 1")
    queries = many.select("type", "key", own.alias("q"), every.alias("i"), F.lit("query").alias("side"), "token")
    index = many.select("type", "key", every.alias("q"), own.alias("i"), F.lit("index").alias("side"), "token")
    on = ["type", "key", "q", "i"]
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes, but much work each
    shards = one.unionByName(queries).unionByName(index).repartition(tasks, *on).sortWithinPartitions(*on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, left, right = None, [], []

        def joined() -> pa.RecordBatch:
            found = [(a, b) for a, b, d in trie_join(left, right) if d <= 1 or max(len(a), len(b)) >= TWO_EDITS_FROM]
            return pa.RecordBatch.from_arrays([pa.array([shard[0]] * len(found), pa.string()), *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))], names=["type", "token", "other"])

        for batch in batches:
            kind, key, q, i, side, token = (c.to_pylist() for c in batch.columns)
            for row in zip(kind, key, q, i, side, token):
                if row[:4] != shard:
                    if shard and len(right) + len(left) > 1:
                        yield joined()
                    shard, left, right = row[:4], [], []
                if row[4] != "index":
                    left.append(row[5])
                if row[4] != "query":
                    right.append(row[5])
        if shard:
            yield joined()

    edited = shards.mapInArrow(run, "type string, token string, other string")
    sound = long.withColumn("_f", folded(F.col("token")))
    alike = sound.join(sound.select("type", F.col("token").alias("other"), "_f"), ["type", "_f"]).filter("token <> other").select("type", "token", "other")
    return edited.union(alike).distinct()


def _map(entries: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def standard_tokens(words: DataFrame) -> DataFrame:
    """type, token, standard: the spelling that a token stands for.

    ``words`` has type, token, n (names that hold it) and occ (how often they occur).  A token takes the most
    frequent neighbour that is at least twice as frequent, or more frequent if it is in one or two names
    itself.  Known given names and nicknames are not touched.
    """
    info = words.select("type", F.col("token").alias("other"), F.col("n").alias("m"), F.col("occ").alias("occ2"))
    near = neighbours(words).join(words, ["type", "token"]).join(info, ["type", "other"])
    more = F.struct("m", "occ2", "other") > F.struct("n", "occ", "token")
    near = near.filter(~((F.col("type") == "PERSON") & F.col("token").isin(sorted(GIVEN))) & more & ((F.col("m") >= 2 * F.col("n")) | (F.col("n") <= 2)))
    near = near.filter((F.length("token") > SHORT) | (F.col("m") >= SHORT_TIMES * F.col("n")))
    best = cut(near.groupBy("type", "token").agg(F.max_by("other", F.struct("m", "occ2", "other")).alias("one")))
    # Pointers are doubled until none moves; each goes to a greater spelling by n, occ and token, so that this ends.
    while True:
        again = best.select("type", F.col("token").alias("one"), F.col("one").alias("two"))
        moved = best.join(again, ["type", "one"], "left")
        best = cut(moved.select("type", "token", F.coalesce("two", "one").alias("one"), F.col("two").isNotNull().alias("_moved")))
        if best.filter("_moved").isEmpty():
            return best.select("type", "token", F.col("one").alias("standard"))


def expand_words(words: DataFrame, names: DataFrame) -> DataFrame:
    """token, full: short tokens of organisations with the most frequent word that they abbreviate.

    An abbreviation of two to six letters has the word's first letter and its letters in the word's order; the word
    is longer, stands beside at least PARTNERS different tokens and is at least three times as frequent.  Both have
    the abbreviation's first three letters (or its two) as a key: the word has a key for each such choice of its letters.
    """
    named = words.filter(F.col("type") == "ORGANIZATION")
    own = names.filter(F.col("type") == "ORGANIZATION").select(F.array_distinct("tokens").alias("_all"))
    beside = own.select(F.explode("_all").alias("full"), "_all").select("full", F.explode("_all").alias("_t")).filter("full <> _t").distinct()  # names are short
    generic = beside.groupBy("full").agg(F.count("*").alias("_deg")).filter(F.col("_deg") >= PARTNERS).drop("_deg")

    def at(word: str, i: Column | int) -> Column:
        return F.substr(word, F.lit(i) if isinstance(i, int) else i, F.lit(1))

    places = F.sequence(F.lit(2), F.length("full"))
    two = F.transform(places, lambda i: F.concat(at("full", 1), at("full", i)))
    three = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.concat(at("full", 1), at("full", i), at("full", j)))))
    common = named.select(F.col("token").alias("full"), F.col("n").alias("m")).filter((F.length("full") >= 3) & (F.col("m") >= 3)).join(generic, "full", "left_semi").withColumn("_key", F.explode(F.array_distinct(F.concat(two, three))))
    short = named.filter((F.length("token") <= 6) & (F.length("token") >= 2)).select("token", "n", F.substring("token", 1, 3).alias("_key"))
    fits = (F.length("full") >= F.length("token") + 1) & (F.col("m") >= 3 * F.col("n")) & F.expr("rlike(full, concat('^', regexp_replace(token, '(.)', '$1.*')))")
    return short.join(common, "_key").filter(fits).groupBy("token").agg(F.max_by("full", F.struct("m", "full")).alias("full"))


def read_names(results: DataFrame) -> DataFrame:
    """type, text, occ, tokens of every different text of a person or organisation."""
    e = results.select(F.explode("entities").alias("e")).select(F.upper(F.trim("e.type")).alias("type"), F.col("e.text").alias("text"))
    texts = e.filter(F.col("type").isin(*TYPES) & F.col("text").isNotNull()).groupBy("type", "text").agg(F.count("*").alias("occ"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tokens(k, t) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], names=["type", "text", "occ", "tokens"])

    return texts.mapInArrow(run, "type string, text string, occ long, tokens array<string>").filter(F.size("tokens") > 0)


def person_keys(people: DataFrame) -> DataFrame:
    """text and key of persons, whose tokens are standard.  ``key`` is null where a short form fits several persons."""
    partner = people.select("text", F.explode("tokens").alias("token")).join(people.select("text", F.explode("tokens").alias("_t")), "text").filter("token <> _t")
    degree = partner.groupBy("token").agg(F.count_distinct("_t").alias("_deg"))
    each = people.select("text", F.size("tokens").alias("_size"), F.posexplode("tokens").alias("at", "token")).join(degree, "token", "left")
    given = F.col("token").isin(sorted(GIVEN | BRIEF))
    # The surname: no initial, no known given name, then the one beside the fewest different tokens.
    order = F.struct((F.length("token") > 1).alias("a"), (~given).alias("b"), (F.length("token") > 3).alias("c"), (-F.coalesce("_deg", F.lit(0))).alias("d"), F.col("at").alias("e"))
    surname = each.groupBy("text").agg(F.max_by(F.struct("token", "at"), order).alias("_s"), F.max("_size").alias("_size"))
    rest = each.drop("_size", "_deg").join(surname, "text").filter((F.col("at") != F.col("_s.at")) & (F.col("_size") > 1))
    first = F.struct((F.length("token") > 1).alias("a"), (-F.col("at")).alias("b"))
    named = rest.groupBy("text", F.col("_s.token").alias("surname")).agg(F.max_by("token", first).alias("g"))
    formals = F.coalesce(_map(FORMAL_OF)[F.col("g")], F.array())
    named = cut(named.withColumn("_formals", formals))
    full = named.filter((F.length("g") > 2) & ((F.size("_formals") == 0)) | (F.size("_formals") == 1)).withColumn("formal", F.when(F.size("_formals") == 1, F.get("_formals", F.lit(0))).otherwise(F.col("g")))
    # Listed names first; other full tokens are names too, unless a listed one of that surname explains them.
    listed = F.col("formal").isin(sorted(NICKNAMES))
    sure = full.filter(listed).select("surname", "formal").distinct()
    short = F.expr("rlike(formal, concat('^', regexp_replace(g, '(.)', '$1.*')))") & (F.length("formal") > F.length("g"))
    fits = F.when(F.size("_formals") > 0, F.array_contains("_formals", F.col("formal"))).otherwise(short)
    open_ = named.join(full.filter(listed).select("text"), "text", "left_anti")
    hits = open_.join(sure, "surname").filter(fits).groupBy("text").agg(F.count_distinct("formal").alias("_k"), F.min("formal").alias("formal"))
    loose = open_.join(hits, "text", "left")
    own = F.when(F.length("g") > 2, F.coalesce(F.get("_formals", F.lit(0)), F.col("g")))
    resolved = loose.select("text", "surname", F.when(F.col("_k") == 1, F.col("formal")).when(F.col("_k").isNull(), own).alias("formal"))
    # Initials beside a surname whose only given names are unlisted ones: different short forms meet different names of one letter.
    unlisted = resolved.filter("formal IS NOT NULL").select("surname", "formal", F.substring("formal", 1, 1).alias("_i")).distinct()
    last = resolved.filter("formal IS NULL").join(named.select("text", "g", "_formals"), "text").drop("formal").join(hits.select("text"), "text", "left_anti")
    forms = last.select("surname", "g", "_formals").distinct()
    nick = forms.filter(F.size("_formals") > 0).select("surname", "g", F.explode("_formals").alias("formal")).join(unlisted.drop("_i"), ["surname", "formal"])
    brief = forms.filter(F.size("_formals") == 0).withColumn("_i", F.substring("g", 1, 1)).join(unlisted, ["surname", "_i"]).filter(short)
    only = nick.select("surname", "g", "formal").union(brief.select("surname", "g", "formal")).groupBy("surname", "g").agg(F.count_distinct("formal").alias("_k"), F.min("formal").alias("formal")).filter("_k = 1").drop("_k")
    more = last.join(only, ["surname", "g"])
    keyed = full.filter(listed).select("text", "surname", "formal").union(resolved.filter("formal IS NOT NULL")).union(more.select("text", "surname", "formal"))
    single = people.filter(F.size("tokens") == 1).select("text", F.get("tokens", F.lit(0)).alias("surname"), F.lit("").alias("formal"))
    return keyed.union(single).select("text", F.concat_ws(" ", "surname", "formal").alias("key"))


def linked_names(results: DataFrame) -> DataFrame:
    """type, text, key: spellings with the same type and key are one person or organisation.

    ``results`` has entities (structs with type and text); other columns are ignored, and repeated rows change
    nothing but frequencies.  Null, empty and "nothing" texts, and short forms that fit several persons, are
    left out.  Ties between spellings go to the greater in code point order.
    """
    names = cut(read_names(results))
    words = names.select("type", "occ", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("type", "token").agg(F.count("*").alias("n"), F.sum("occ").alias("occ"))
    words = cut(words)
    standard = cut(standard_tokens(words))
    placed = names.select("type", "text", F.posexplode("tokens").alias("at", "token")).join(standard, ["type", "token"], "left").withColumn("token", F.coalesce("standard", "token")).drop("standard")
    brief = expand_words(words, names).withColumn("type", F.lit("ORGANIZATION"))
    placed = placed.join(brief, ["type", "token"], "left").withColumn("token", F.coalesce("full", "token"))
    again = placed.groupBy("type", "text").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("tokens"))  # a name's own tokens
    again = cut(again)
    people = person_keys(again.filter(F.col("type") == "PERSON").select("text", "tokens")).select(F.lit("PERSON").alias("type"), "text", "key")
    others = again.filter(F.col("type") == "ORGANIZATION").select("type", "text", F.concat_ws(" ", F.array_sort(F.array_distinct("tokens"))).alias("key"))
    return people.union(others)


def name_pairs(results: DataFrame) -> DataFrame:
    """entity_type, name_a, name_b of every two different spellings of one person or organisation."""
    linked = cut(linked_names(results))
    a, b = linked.select("type", "key", F.col("text").alias("name_a")), linked.select("type", "key", F.col("text").alias("name_b"))
    return a.join(b, ["type", "key"]).filter(F.col("name_a") < F.col("name_b")).select(F.col("type").alias("entity_type"), "name_a", "name_b")
