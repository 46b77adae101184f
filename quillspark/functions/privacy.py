"""Personal data: seeds in a text, their variants, redaction and offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as text_forms
from quillspark.functions.arrays import let

# Patterns of e-mails, student numbers and phones.
EMAIL = r"(?<![@.])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
STUDENT = (
    r"(?iu)\b(?:matrikel(?:nummer|nr\.?)?|student(?:en)?(?:nummer|id|number)|registration\s*number|n[uú]mero\s*de\s*matr[íi]cula|n[ºo°]?\s*matr[ií]cul[oa]|registrazione)"
    r"\s*[:#-]?\s*([A-Z]?\d[\d\s./-]{3,}\d)"
)
PHONE_LABELLED = r"(?iu)\b(?:tel(?:\.|efon)?|mobil(?:funk)?|handy|phone|fax|t\.|tel\s*nr\.?)\s*[:.]?\s*([+]?[\d\s./()-]{7,20}\d)"
PHONE_ABROAD = r"(?<![\d])\+\d{1,3}[\s./()-]*(?:\d[\s./()-]*){6,15}\d"
DATE_LIKE = r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$|^\d{4}-\d{2}-\d{2}$|^\d{2}\.\d{2}\.\d{4}$"
TITLES = re.compile(text_forms.TITLES, re.ASCII)


# Headings of first chapters, which end the front matter.
FIRST_CHAPTERS = (
    "einleitung|einf(?:ue|ü)hrung|introduction|introduzione|introducci[oó]n|introdu[cç][aã]o|inleiding|wst[eę]p|[uú]vod|inledning|indledning|innledning|johdanto|εισαγωγή|giri[şs]|введение|"
    "序論|序章|引言|前言|序|chapter\\s+1|chapitre\\s+1|kapitel\\s+1|cap[ií]tulo\\s+1|capitolo\\s+1|hoofdstuk\\s+1|rozdzia[lł]\\s+1|kapitola\\s+1|kapitel\\s+ett|αʹ\\s*κεφάλαιο|глава\\s+1|第一章|الفصل\\s+الأول|المقدمة|مقدمة"
)


def front_matter(text: Column, most: int = 10_000) -> Column:
    """The first characters, cut before the first chapter's heading."""
    head = F.substring(text, 1, most)
    at = F.regexp_instr(head, F.lit(rf"(?imu)^\s*(?:\d+(?:\.\d+)*\s+)?(?:{FIRST_CHAPTERS})\b"))
    return F.when(at > 201, F.substring(head, F.lit(1), at - 1)).otherwise(head)


def emails(text: str | Column) -> Column:
    """E-mail addresses, without digits run together with their front."""
    col = F.col(text) if isinstance(text, str) else text
    found = F.when(col.contains("@"), F.regexp_extract_all(col, F.lit(EMAIL), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^\d+(?=[A-Za-z][^@]*@)", "")))


def student_ids(text: str | Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(STUDENT), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"[\s./-]+", "")), lambda x: F.length(x) >= 4))


def phones(text: str | Column) -> Column:
    """Phone numbers with a label or a country code; dates are none."""
    fit = lambda x: F.length(F.regexp_replace(x, r"\D", "")).between(7, 16)
    near = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PHONE_LABELLED), F.lit(1)), lambda x: F.trim(x)), lambda x: fit(x) & ~x.rlike(DATE_LIKE))
    far = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PHONE_ABROAD), F.lit(0)), lambda x: F.trim(x)), fit)
    return F.array_distinct(F.concat(near, far))


SEED = "struct<category:string,value:string,replacement:string>"


def contact_seeds_of(text: str | Column) -> Column:
    """array<struct<category, value, replacement>> of the contact data of a
    text; the first of equal values (whatever the case) counts, and each
    category is numbered.  It is all within the row."""
    col = F.col(text) if isinstance(text, str) else text
    norm = lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))

    def numbered(kind: str, values: Column) -> Column:
        first = let(values, lambda v: F.filter(v, lambda x, i: ~F.exists(F.slice(v, F.lit(1), i), lambda y: norm(y) == norm(x))))
        return F.transform(first, lambda x, i: F.struct(F.lit(kind).alias("category"), x.alias("value"), F.format_string(f"[{kind.upper()}_%03d]", i + 1).alias("replacement")))

    parts = [numbered("email", emails(col)), numbered("student_id", student_ids(col)), numbered("phone", phones(front_matter(col)))]
    return F.coalesce(F.concat(*[F.coalesce(x, F.array().cast(f"array<{SEED}>")) for x in parts]), F.array().cast(f"array<{SEED}>"))


def contact_seeds(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(document_id, category, value, replacement), a row for each seed."""
    return docs.select(F.col(doc_id).alias("document_id"), F.explode(contact_seeds_of(text)).alias("s")).select("document_id", "s.*")


@F.pandas_udf(T.ArrayType(T.StringType()))
def variants_of(names: pd.Series) -> pd.Series:
    """``name_variants`` of a column."""
    return names.map(lambda x: name_variants(x) if x else [])


def name_variants(name: str) -> list[str]:
    """Forms a person's name may have in a text, the longest first."""
    plain = re.sub(r"^[ ,;:.-]+|[ ,;:.-]+$", "", " ".join(TITLES.sub("", name).split()))
    forms = [" ".join(name.split()).strip(" ,;:-"), plain]
    words = plain.split()
    if "," in plain:
        last, first = (x.strip() for x in plain.split(",", 1))
    elif len(words) > 1:
        first, last = " ".join(words[:-1]), words[-1]
    else:
        first = last = ""
    if first and last:
        forms += [f"{first} {last}", f"{last}, {first}", f"{first[0]}. {last}", last]
    return sorted((x for x in dict.fromkeys(forms) if x), key=len, reverse=True)


_EDGES = {"email": (r"(?<![@_])", r"(?![A-Za-z0-9._%+\-]|@)"), "student_id": (r"(?<!\d)", r"(?!\d)"), "phone": (r"(?<!\d)", r"(?!\d)")}
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType()), T.StructField("category", T.StringType())]))


def find_edits(text: str, seeds: list[dict]) -> list[dict]:
    """Places to replace: longer variants first, none overlapping another."""
    free, out = bytearray(len(text)), []
    forms = sorted(((v, s) for s in seeds for v in s["variants"] if v), key=lambda x: -len(x[0]))
    for form, seed in forms:
        left, right = _EDGES.get(seed["category"], (r"(?<!\w)", r"(?!\w)"))
        body = r"\s+".join(map(re.escape, form.split())) or re.escape(form)
        for m in re.finditer(left + body + right, text, re.I):
            if not any(free[m.start() : m.end()]):
                free[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                out.append({"start": m.start(), "end": m.end(), "replacement": seed["replacement"], "category": seed["category"]})
    return sorted(out, key=lambda e: e["start"])


@F.pandas_udf(EDITS)
def edits(texts: pd.Series, seeds: pd.Series) -> pd.Series:
    """``seeds``: array<struct<category, variants, replacement>> of each text."""
    return pd.Series([find_edits(t or "", [s if isinstance(s, dict) else s.asDict() for s in (x if x is not None else [])]) for t, x in zip(texts, seeds, strict=True)])


def redacted(text: Column, edits: Column) -> Column:
    """A text with its edits made: the pieces between them, joined."""
    done = F.aggregate(
        edits, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, e: F.struct(F.concat(acc.out, F.substring(text, acc.at + 1, e.start - acc.at), e.replacement).alias("out"), e.end.alias("at")),
        lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))),
    )
    return F.when(F.size(edits) > 0, done).otherwise(text)


def moved(start: Column, end: Column, edits: Column) -> Column:
    """struct(start, end) of an element after the edits of its text: earlier
    edits shift it, those inside resize it, those over its edge do nothing."""
    grow = lambda e: F.length(e.replacement) - (e.end - e.start)
    before = F.aggregate(F.filter(edits, lambda e: e.end <= start), F.lit(0), lambda s, e: s + grow(e))
    inside = F.aggregate(F.filter(edits, lambda e: (e.start >= start) & (e.end <= end) & (e.end > start)), F.lit(0), lambda s, e: s + grow(e))
    return F.struct((start + before).alias("start"), (end + before + inside).alias("end"))


def leaks(texts: DataFrame, seeds: DataFrame, context: int = 40) -> DataFrame:
    """First candidate of each seed that a text still holds: texts (document_id,
    text), seeds (document_id, seed_id, variants); short ones need word edges.
    The seeds of a document come to its text as one array."""
    held = seeds.groupBy("document_id").agg(F.collect_list(F.struct("seed_id", "variants")).alias("seeds"))  # of one document
    plain = lambda v: F.instr(F.lower("text"), F.lower(v))
    edge = lambda v: F.regexp_instr("text", F.concat(F.lit(r"(?iu)(?<!\w)\Q"), v, F.lit(r"\E(?!\w)")))
    hit = lambda v, pos: F.struct(pos.alias("pos"), v.alias("candidate"), F.when(F.length(v) <= 3, edge(v)).otherwise(plain(v)).alias("at"))
    hits = lambda s: F.filter(F.transform(s["variants"], hit), lambda h: h["at"] > 0)
    found = F.filter(F.transform("seeds", lambda s: F.struct(s["seed_id"].alias("seed_id"), F.get(hits(s), F.lit(0)).alias("b"))), lambda x: x["b"].isNotNull())
    near = lambda b: F.substring("text", F.greatest(F.lit(1), b["at"] - context), F.length(b["candidate"]) + 2 * context)
    out = F.transform(found, lambda x: F.struct(x["seed_id"].alias("seed_id"), x["b"]["candidate"].alias("candidate"), (x["b"]["at"] - 1).alias("start"), near(x["b"]).alias("context")))
    return texts.join(held, "document_id").select("document_id", F.explode(out).alias("l")).select("document_id", "l.*")


# Labels that give a person near them a role.
ROLE_LABELS = (
    (
        "author",
        r"(?iu)\b(?:vorgelegt|eingereicht|verfasst|abgegeben|presented|submitted|prepared|written|presentado|presentata|apresentado|przedstawion[aey]|ingeleverd|inskickad|indleveret|innlevert|esitetty)"
        r"\s+(?:von|by|par|de|por|da|door|przez|av|af|tarafından|представлена)\b",
    ),
    ("author", r"(?iu)\b(?:autor(?:in)?|author|verfasser(?:in)?|bearbeiter(?:in)?|kandidat(?:in)?|name|verfasst\s+von)\b"),
    (
        "supervisor",
        r"(?iu)\b(?:betreuer(?:in)?|erstgutachter(?:in)?|zweitgutachter(?:in)?|drittgutachter(?:in)?|pr(?:ue|ü)fer(?:in)?|gutachter(?:in)?|mentorat|mentor(?:in)?|doktorvater|doktormutter|promotionskommission"
        r"|pr(?:ue|ü)fungskommission|promotionsausschuss|supervisor|advisor|examiner|director\s+of\s+studies|directeur(?:\s+de\s+th[èe]se)?|relatore|orientador(?:a)?|begeleider|promotor|opiekun|veiledere?"
        r"|handledare|ohjaaja|jury)\b",
    ),
)


def role_labels(docs: DataFrame, doc_id: str = "document_id", text: str = "text") -> DataFrame:
    """(document_id, pos, role) of every label in the front matter."""
    out = None
    for role, pattern in ROLE_LABELS:
        # the pieces before each hit give its place
        head = front_matter(F.col(text))
        hits = F.arrays_zip(F.split(head, pattern).alias("a"), F.regexp_extract_all(head, F.lit(pattern), F.lit(0)).alias("h"))
        each = docs.select(F.col(doc_id).alias("document_id"), F.posexplode(hits).alias("n", "x"))
        w = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.sum(F.length(F.coalesce("x.a", F.lit("")))).over(w) + F.coalesce(F.sum(F.length("x.h")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        one = each.withColumn("pos", upto).where("x.h is not null").select("document_id", F.col("pos").cast("long").alias("pos"), F.lit(role).alias("role"))
        out = one if out is None else out.unionByName(one)
    return out


def person_roles(persons: DataFrame, labels: DataFrame, within: int = 150) -> DataFrame:
    """Persons (document_id, start, ...) with the role of the nearest label at
    most ``within`` characters before them; without one the first person of a
    document is its author, later ones are others.  An as-of match by window."""
    keep = persons.columns
    both = persons.withColumn("_at", F.col("start").cast("long")).withColumn("_l", F.lit(None).cast("struct<pos:long,role:string>"))
    marks = labels.select("document_id", F.col("pos").alias("_at"), F.struct("pos", "role").alias("_l"))
    w = Window.partitionBy("document_id").orderBy("_at", F.col("_l").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = F.last("_l", ignorenulls=True).over(w)
    first = F.row_number().over(Window.partitionBy("document_id").orderBy("_at")) == 1
    joined = both.unionByName(marks, allowMissingColumns=True).withColumn("_n", near).where("_l is null")
    role = F.when(F.col("_at") - F.col("_n.pos") <= within, F.col("_n.role")).when(first, "author").otherwise("other")
    return joined.withColumn("role", role).select(*keep, "role")


def split_persons(persons: DataFrame) -> DataFrame:
    """Persons (document_id, text, start) whose span runs two names together,
    split before titles and brackets; parts of fewer than two names go."""
    cut = r"\s+(?=\(|Prof\.|Dr\.|Mr\.|Mrs\.|Hon\.|PhD\.?|MD\.?)"
    parts = persons.withColumn("_p", F.explode(F.split("text", cut)))
    bare = F.trim(F.regexp_replace("_p", r"^\(?(?:(?:Prof|Dr|h\.c|phil|theol|med|iur|nat|Mr|Mrs|Hon|Sir)\.?\s+)+", ""))
    out = parts.withColumn("name", bare).where(F.size(F.regexp_extract_all("name", F.lit(r"\p{Lu}[\p{L}'’-]+"), F.lit(0))) >= 2)
    return out.select("document_id", F.col("name").alias("text"), (F.col("start") + F.expr("instr(text, name)") - 1).alias("start"))


# Marks of what is blacked out, and labels of authors.
GLYPHS = r"[█▓▒░■▄▀▌▐]{3,}|[X]{4,}|[x]{4,}|[*]{4,}|_{4,}"
BRACKETED = r"(?iu)\[\s*(?:anonymisiert|anonymized|redacted|name|n\.n\.|nn|xxx+|geschw[aä]rzt|caviardé|censurado|oscurato|verwijderd|usuni[eę]ty|cenzurov[áa]no)\s*\]"
WORDED = r"(?iu)\b(?:anonymisiert|anonymized|redacted|geschw[aä]rzt|caviardé|censurado|oscurato|usuni[eę]ty|n\.\s*n\.|XXXX+|xxxx+)\b"
AUTHOR_LABEL = (
    r"\b(?:vorgelegt\s+von|eingereicht\s+von|verfasst\s+von|submitted\s+by|presented\s+by|written\s+by|autor(?:in)?|author|verfasser(?:in)?|name|nom|nombre|nome|naam|tekijä|szerző|αυτή|yazar|автор)\s*[:.]?\s*"
)


def author_state(text: Column) -> Column:
    """``redacted``, ``name_present`` or ``no_author_label``: what stands after
    the first label of an author in the front matter that tells (on its line,
    else on the next one)."""
    lines = F.transform(F.split(front_matter(text), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))

    def state(lines: Column, line: Column, i: Column) -> Column:
        tail = F.trim(F.regexp_extract(line, rf"(?iu)^.*?{AUTHOR_LABEL}(.*)$", 1))
        said = F.when(tail != "", tail).otherwise(F.coalesce(F.get(lines, i + 1), F.lit("")))
        names = F.size(F.regexp_extract_all(said, F.lit(r"\p{Lu}[\p{L}\p{M}.'’-]{1,}|\p{Lu}\."), F.lit(0)))
        bare = F.trim(F.regexp_replace(said, r"\([^)]*\)", ""))
        named = (F.length(bare) >= 5) & names.between(2, 5)
        out = F.when(said.rlike(GLYPHS) | said.rlike(BRACKETED) | said.rlike(WORDED), "redacted").when(named, "name_present")
        return F.when(line.rlike(rf"(?iu){AUTHOR_LABEL}"), out)

    told = F.filter(let(lines, lambda own: F.transform(own, lambda x, i: state(own, x, i))), lambda x: x.isNotNull())
    return F.coalesce(F.get(told, F.lit(0)), F.lit("no_author_label"))


def redaction_state(text: Column, seeds: Column) -> Column:
    """What is to be done with a document: ``skipped_already_redacted`` if its
    author is blacked out, ``no_candidates`` without seeds, else ``applied``."""
    return F.when(author_state(text) == "redacted", "skipped_already_redacted").when(F.size(seeds) == 0, "no_candidates").otherwise("applied")


def redact_again(docs: DataFrame, done: DataFrame, seeds: str = "seeds") -> DataFrame:
    """Documents redacted anew from their originals (document_id, text, seeds);
    ``done`` (document_id, outline_status) keeps what a user has confirmed."""
    e = docs.withColumn("edits", edits("text", seeds))
    new = e.select("document_id", redacted(F.col("text"), F.col("edits")).alias("text"), F.size("edits").alias("n_edits"))
    return new.join(done.select("document_id", "outline_status"), "document_id", "left")


# Labels of a work's title.
TITLE_LABELS = "titel|title|titre|t[íi]tulo|titolo|onderwerp|otsikko|tittel|nadpis|başlık|название|θέμα|عنوان|主題|题目|제목"


def title_hint(text: Column, misc: Column) -> Column:
    """A work's title: what follows its first label up to the end of the sentence
    or line (else 200 characters) if that is eight characters or more, else the
    first name of a work (``misc``: array of strings) of 12 to 200 characters."""
    tail = F.regexp_extract(front_matter(text), rf"(?isu)\b(?:{TITLE_LABELS})\s*[:.]?\s*(.*)$", 1)
    ended = F.regexp_extract(tail, r"^([^.\n]+(?:\.[^.\n]*)*?)(?:[.!?](?=\s+\p{Lu}|\s*$|\s*\n)|\n)", 1)
    named = F.trim(F.regexp_replace(F.when(ended != "", ended).otherwise(F.substring(tail, 1, 200)), r"\s+", " "))
    fit = F.filter(misc, lambda x: F.length(x).between(12, 200))
    return F.when(F.length(named) >= 8, named).otherwise(F.trim(F.get(fit, F.lit(0))))
