"""Canonical exact digests of documents, and groups of equal ones."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, ranked, saved

#: doc_ids of one block of 2**BLOCK_BITS consecutive numbers meet in one window group.
BLOCK_BITS = 6


@cache
def _tables() -> dict[str, str]:
    """By rule from the Unicode database, over all planes: characters with a one-character compatibility form and those
    forms; as text for str_to_map, longer compatibility forms, compositions of a base and a mark, the full canonical
    forms of composed characters, and the combining classes of marks; as character classes of a regular expression, the
    characters with longer forms, the marks that have a class, and what follows a base without one (pairs of those)."""
    single, form, longer, pairs, parts, classes, special, marks, follow = [], [], [], [], [], [], [], [], []
    for n in range(0x80, 0x110000):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4:
            continue
        k = unicodedata.normalize("NFKC", c)
        if k != c:
            if len(k) == 1:
                single.append(c)
                form.append(k)
            else:
                longer.append(f"{c}\x01{k}")
                special.append(n)
        if unicodedata.combining(c):
            classes.append(f"{c}\x01{unicodedata.combining(c)}")
            marks.append(n)
        whole = unicodedata.normalize("NFD", c)
        d = unicodedata.normalize("NFC", whole[:-1]) + whole[-1:] if len(whole) > 1 else whole
        if len(d) == 2 and unicodedata.normalize("NFC", d) == c and k == c:
            if unicodedata.combining(d[1]):
                pairs.append(f"{d}\x01{c}")
                if all(map(unicodedata.combining, whole[1:])):
                    parts.append(f"{c}\x01{whole}")
            else:
                follow.append((d, c))
    join = lambda x: "\x02".join(x)
    # What any mark or second letter is, in few terms: Unicode's marks, and those that are none.
    others = [n for n in sorted({*marks, *(ord(d[1]) for d, _ in follow)}) if unicodedata.category(chr(n))[0] != "M"]
    some = "[\\p{M}" + (_class(others)[1:-1] if others else "") + "]"
    return {"some": some, "singles_of_longer": "".join(map(chr, special)), "single": "".join(single), "form": "".join(form), "longer": join(longer), "pairs": join(pairs), "parts": join(parts), "classes": join(classes), "special": _class(special), "marks": _class(marks), "follow": join(f"{d}\x01{c}" for d, c in follow), "second": _class(sorted({ord(d[1]) for d, _ in follow}))}


def _class(codes: list[int]) -> str:
    """A character class of sorted code points, as ranges."""
    out: list[list[int]] = []
    for n in codes:
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def _let(value: Column, f) -> Column:
    """f(value), with value named once: the tables stand once in the plan."""
    return F.transform(F.array(value), f)[0]


def _map(text: str) -> Column:
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def _pieces(text: Column, cut: str, f) -> Column:
    return F.array_join(F.transform(F.split(text, cut), f), "")


def _composed(piece: Column, parts: Column, classes: Column, pairs: Column) -> Column:
    """A base with its marks: taken apart, marks put in the order of their classes, and composed again, a mark that one
    of the same class or a higher one stands before staying apart."""
    each = lambda c: F.filter(F.split(c, r"(?<=\P{Cs})"), lambda x: x != "")
    chars = F.flatten(F.transform(each(piece), lambda c: each(F.coalesce(F.try_element_at(parts, c), c))))
    rank = lambda c: F.coalesce(F.try_element_at(classes, c), F.lit("0")).cast("int")
    marked = F.transform(chars, lambda c, i: F.struct(F.when(i == 0, -1).otherwise(rank(c)).alias("k"), i.alias("i"), c.alias("c")))
    ordered = F.array_sort(marked)
    start = F.struct(F.lit("").alias("base"), F.lit("").alias("tail"), F.lit(0).alias("last"))

    def step(s: Column, m: Column) -> Column:
        known = F.when(s["last"] < m["k"], F.try_element_at(pairs, F.concat(s["base"], m["c"])))
        made = lambda base, tail, last: F.struct(base.alias("base"), tail.alias("tail"), last.alias("last"))
        return F.when(m["k"] < 0, made(m["c"], F.lit(""), F.lit(0))).when(known.isNotNull(), made(known, s["tail"], s["last"])).otherwise(made(s["base"], F.concat(s["tail"], m["c"]), m["k"]))

    return F.aggregate(ordered, start, step, lambda s: F.concat(s["base"], s["tail"]))


def _syllables(text: Column) -> Column:
    """Hangul syllables of conjoining letters: leading and vowel first, then that and the trailing one."""
    char = lambda n: F.decode(F.unhex(F.hex(n.cast("long"))), "UTF-16BE")
    code = lambda p, at: F.ascii(F.substring(p, at, 1))
    rest = lambda p: F.substr(p, F.lit(3))
    lead, last = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}]", r"[\x{ac00}-\x{d7a3}][\x{11a8}-\x{11c2}]"
    open_ = _pieces(text, f"(?={lead})", lambda p: F.when(p.rlike(f"^{lead}"), F.concat(char(0xAC00 + ((code(p, 1) - 0x1100) * 21 + code(p, 2) - 0x1161) * 28), rest(p))).otherwise(p))
    return _let(open_, lambda t: _pieces(t, f"(?={last})", lambda p: F.when(p.rlike(f"^{last}") & ((code(p, 1) - 0xAC00) % 28 == 0), F.concat(char(code(p, 1) + code(p, 2) - 0x11A7), rest(p))).otherwise(p)))


def canonical(text: Column) -> Column:
    """The text after Unicode normalisation, case and white-space folding; null is empty.

    Normalisation is that of NFKC for the Unicode version of this Python: compatibility forms of single characters
    become plain, longer ones (ligatures, fractions) are spelled out, marks are put in order and composed with their
    base, Hangul letters become syllables. Case: lower of upper. White space: runs become one space, none at the ends.
    Pure ASCII text skips the first part, text without marks, longer forms and Hangul letters most of it.
    """
    t_ = _tables()
    odd, mark, second = t_["special"], t_["marks"], t_["second"]
    plain_mark, first = f"[^{mark[1:-1]}\\p{{Cs}}]", f"[^{second[1:-1]}\\p{{Cs}}]"  # never between the halves of a pair

    def normal(t: Column) -> Column:
        # translate() looks characters up by hash (those without a partner go); a class of many ranges in a regular
        # expression tries them in turn. So cheap tests tell whether a text needs one.
        short = F.translate(t, t_["single"] + t_["singles_of_longer"], t_["form"])
        spelled = lambda s: F.when(F.char_length(s) == F.char_length(t), s).otherwise(_let(F.translate(t, t_["single"], t_["form"]), apart))
        apart = lambda s: F.when(s.rlike(odd), _let(_map(t_["longer"]), lambda known: _pieces(s, f"(?={odd})|(?<={odd})", lambda p: F.coalesce(F.try_element_at(known, p), p)))).otherwise(s)
        tables = F.struct(_map(t_["parts"]).alias("parts"), _map(t_["classes"]).alias("classes"), _map(t_["pairs"]).alias("pairs"))
        cut = f"(?={plain_mark}{mark})|(?<={mark})(?={plain_mark})"
        by_mark = lambda s: F.when(s.rlike(t_["some"]) & s.rlike(mark), _let(tables, lambda k: _pieces(s, cut, lambda p: F.when(p.rlike(mark), _composed(p, k["parts"], k["classes"], k["pairs"])).otherwise(p)))).otherwise(s)
        follow = lambda s: F.when(s.rlike(t_["some"]) & s.rlike(second), _let(_map(t_["follow"]), lambda known: _pieces(s, f"(?={first}{second})|(?<={second})", lambda p: F.coalesce(F.try_element_at(known, p), p)))).otherwise(s)
        hangul = lambda s: F.when(s.rlike(r"[\x{1161}-\x{1175}\x{11a8}-\x{11c2}]"), _syllables(s)).otherwise(s)
        # Two rounds of pairs without a class: a third letter follows some of them.
        return _let(_let(_let(_let(_let(short, spelled), follow), follow), by_mark), hangul)

    text = F.coalesce(text, F.lit(""))
    folded = F.lower(F.upper(_let(text, lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(normal(t)))))
    spaces = r"\x09-\x0D\x1C-\x20\x{85}\x{2028}\x{2029}"
    return F.trim(F.regexp_replace(folded, rf"[{spaces}]{{2,}}|[{spaces}&&[^ ]]", " "))


def digest(canon: Column) -> Column:
    """128 bits in hexadecimal: two 64-bit xxhash values under different seeds."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    both = lambda c: F.concat(part(F.xxhash64(c)), part(F.xxhash64(F.lit(0x5EED), c)))
    return F.transform(F.array(canon), both)[0]


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", prints: DataFrame | None = None) -> DataFrame:
    """(key, fingerprint, group_id) of the rows of df whose canonical text another row has: group_id is the least key.

    Rows meet by fingerprint. The texts of buckets with two rows or more are kept, and each is compared byte by byte
    with the bucket's first; one that differs (a collision of 128 bits) is grouped by its SHA-256 instead. A hot bucket
    is a join key that Spark splits, not a group in one task. prints: (key, fingerprint) of all rows, where these are
    known already. Null texts are empty texts; null keys are keys like others and come first; repeated rows are
    members like others. No rows, no groups.
    """
    if prints is None:
        prints = saved(df.select(F.col(key), digest(canonical(F.col(text))).alias("fingerprint")))
    prints = prints.select(F.col(key).alias("_key"), "fingerprint")
    several = prints.groupBy("fingerprint").agg(F.count("*").alias("_n"), F.min_by("_key", F.struct(F.col("_key"))).alias("_first")).where("_n > 1").drop("_n")
    # Only texts of keys in shared buckets are made canonical once more, to be compared.
    wanted = prints.join(several.select("fingerprint"), "fingerprint", "left_semi").select(F.col("_key").alias("_wanted")).distinct()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.join(wanted, rows["_key"].eqNullSafe(wanted["_wanted"]), "left_semi").select("_key", canonical(F.col("_text")).alias("_canon")).withColumn("fingerprint", digest(F.col("_canon")))
    met = saved(rows.join(several, "fingerprint"))
    first = met.where(F.col("_key").eqNullSafe(F.col("_first"))).groupBy("fingerprint").agg(F.min("_canon").alias("_same"))
    judged = saved(met.join(first, "fingerprint").select("_key", "fingerprint", "_first", (F.col("_canon") == F.col("_same")).alias("_equal"), F.sha2("_canon", 256).alias("_sha")))
    odd = judged.where(~F.col("_equal")).groupBy("fingerprint", "_sha").agg(F.min("_key").alias("_other"))
    group = F.when(F.col("_equal"), F.col("_first")).otherwise(F.col("_other"))
    return judged.join(odd, ["fingerprint", "_sha"], "left").select(F.col("_key").alias(key), "fingerprint", group.alias("group_id")).distinct()


def over_next(docs: DataFrame, columns: list[str], made: dict[str, Column], key: str = "doc_id") -> DataFrame:
    """The columns `made` of every row, from key, columns and next_<column>: the values of the row that follows it by
    (key, then columns), and of the first row after the last.

    Rows meet once, in blocks of consecutive keys (2**BLOCK_BITS). Null keys come first; rows of one key follow each
    other by a hash of their columns, and where a key has many rows (or is null) blocks are of a key and the hash's
    high bits, so that a hot key is many blocks. The last row of a block is finished from the first row of the next
    block that has rows; blocks are ranked for that. A single row follows itself.
    """
    docs = docs.select(key, *columns).withColumn("_hash", F.xxhash64(*columns))
    most = docs.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    fine = F.lit(most > 1 << BLOCK_BITS) | F.col(key).isNull()
    docs = docs.withColumn("_blk", F.struct(F.when(fine, F.col(key)).otherwise(F.shiftright(key, BLOCK_BITS)).alias("k"), F.when(fine, F.shiftright("_hash", 44)).otherwise(0).alias("h")))
    within = Window.partitionBy("_blk").orderBy(F.col(key).asc_nulls_first(), "_hash", *[F.col(c).asc_nulls_first() for c in columns])
    own = F.struct(key, *columns)
    inner = docs.withColumn("_next", F.lead(F.struct(*columns)).over(within)).withColumn("_no", F.row_number().over(within))
    inner = inner.select("*", *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])
    edge = {"_blk": F.col("_blk"), "_tail": F.when(F.col("_next").isNull(), own), "_head": F.when(F.col("_no") == 1, own)}
    laid = saved(inner.select(*[c.alias(n) for n, c in {**made, **edge}.items()]))
    blocks = saved(ranked(laid.where("_head is not null").select("_blk"), F.col("_blk.k").asc_nulls_first(), F.col("_blk.h")))
    n = blocks.count()
    after = blocks.select(F.col("_blk").alias("_from"), F.pmod(F.col("rank") + 1, F.lit(max(n, 1))).alias("rank")).join(blocks, "rank").select("_from", F.col("_blk").alias("_to"))
    heads = laid.where("_head is not null").select(F.col("_blk").alias("_at"), "_head")
    follow = after.join(heads, after["_to"].eqNullSafe(heads["_at"])).select("_from", "_head")
    tails = laid.where("_tail is not null").select("_blk", "_tail")
    ends = tails.join(follow, tails["_blk"].eqNullSafe(follow["_from"]))
    ends = ends.select(F.col(f"_tail.{key}").alias(key), *[F.col(f"_tail.{c}").alias(c) for c in columns], *[F.col(f"_head.{c}").alias(f"next_{c}") for c in columns])
    return laid.where("_tail is null").select(*made).unionByName(ends.select(*[c.alias(n) for n, c in made.items()]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each of docs (doc_id, text): its digest, the digest of its edited text, and both likenesses.

    The edited text ends with the start of the next document instead of its own last quarter. A likeness is 1.0 for
    equal digests and else 0.0, as an exact digest has nothing between. group_id is the least doc_id of the rows with
    the same canonical bytes. Null texts are empty; a null doc_id has group_id null unless its text is shared; rows
    with the same doc_id follow each other by text; other columns of docs are not read. No rows give no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.withColumn("fingerprint", digest(canonical(F.col("text"))))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    rows = over_next(known, ["text", "fingerprint"], {
        "doc_id": F.col("doc_id"),
        "n_chars": n.cast("long"),
        "edited_sha256": F.sha2(F.encode(edited, "UTF-8"), 256),
        "fingerprint": F.col("fingerprint"),
        "edited_fingerprint": digest(canonical(edited)),
        "near_next": same("fingerprint", "next_fingerprint"),
    })
    rows = saved(rows).withColumn("near_edited", same("fingerprint", "edited_fingerprint"))
    groups = exact_groups(docs, prints=rows)
    met = (rows["fingerprint"] == groups["fingerprint"]) & rows["doc_id"].eqNullSafe(groups["doc_id"])
    return rows.join(groups, met, "left").select(*[rows[c] for c in rows.columns], F.coalesce(groups["group_id"], rows["doc_id"]).alias("group_id"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))
