"""Markers of a paragraph's or heading's function, as built-in expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.arrays import let

# Heading rules in order; the first that matches gives type and confidence.
HEADING_RULES = (
    (r"\bexkurs(e|us)?\b", "EXKURS", 0.95),
    (r"\b(einleitung|einführung|prolog|vorwort|problemstellung)\b", "EXPOSITION", 0.9),
    (r"\b(fazit|schluss(folgerung|wort|betrachtung)?|conclusio|ausblick|reflexion)\b", "SCHLUSSREFLEXION", 0.9),
    (r"\b(methodolog\w*|forschungsdesign|forschungsmethod\w*|methodisch\w* (vorgehen|ansatz|grundlegung)|verfahren der untersuchung)\b", "FORSCHUNGSDESIGN", 0.9),
    (r"\b(theoretisch\w* (rahmen|grundlagen|hintergrund|fundierung)|theoretisch\w* (perspektive|zugang|verortung))\b", "GRUNDLAGENTHEORIE", 0.85),
    (r"\b(stand der forschung|forschungsstand|literaturüberblick|literature review|begriffsklärung)\b", "GRUNDLAGENTHEORIE", 0.85),
    (r"\b(diskussion|interpretation|synthese|zusammenführung|integration der ergebnisse)\b", "SYNTHESE", 0.85),
    (r"\b(empirische ergebnisse|datenanalyse|auswertung|empirie|empirische befunde|empirische untersuchung)\b", "DURCHFUEHRUNG", 0.85),
    (r"\b(ergebnisse|befunde|durchführung|fallanalyse|fallstudie)\b", "DURCHFUEHRUNG", 0.7),
    (r"\bmethod(en|ik)?\b", "FORSCHUNGSDESIGN", 0.7),
    (r"\b(grundlagen|theorie|theoretisch\w*)\b", "GRUNDLAGENTHEORIE", 0.7),
)
# Granularity of each type.
GRANULARITY = {
    "EXPOSITION": "KAPITEL",
    "GRUNDLAGENTHEORIE": "UNTERKAPITEL",
    "FORSCHUNGSDESIGN": "KAPITEL",
    "DURCHFUEHRUNG": "UNTERKAPITEL",
    "EXKURS": "KAPITEL",
    "SYNTHESE": "KAPITEL",
    "SCHLUSSREFLEXION": "KAPITEL",
}
# Markers of findings, with their names.
FINDINGS = (
    ("zeigt_sich", r"(?iu)\b(zeigt(e)?\s+sich|zeigen\s+sich|gezeigt\s+(werden|wurde|wird))\b"),
    ("befund_lemma", r"\b(Befund(e|s|en)?|Ergebnis(se|ses|sen)?|Resultat(e|s|en)?)\b"),
    ("ergibt_sich", r"(?iu)\b(ergibt|ergab)\s+sich\b"),
    ("feststellen", r"(?iu)\b(fest(gestellt|zuhalten|halten|stellen|stellt))\b"),
    ("lassen_sich", r"(?iu)\b(lässt|läßt|lassen)\s+(sich\s+)?(erkennen|konstatieren|festhalten|ableiten|schließen|resümieren|zeigen)\b"),
    ("hervorgehen", r"(?iu)\b(hervor(zugehen|geht|gehen|gegangen|gehend))\b"),
    ("deutlich_werden", r"(?iu)\bdeutlich\s+(wird|werden|geworden|wurde)\b"),
    ("weist_hin", r"(?iu)\b(weist|weisen)\s+darauf\s+hin\b"),
    ("deutet_hin", r"(?iu)\bdeutet\s+(darauf\s+hin|sich\s+an)\b"),
    ("macht_deutlich", r"(?iu)\b(macht|machen)\s+(deutlich|sichtbar|erkennbar)\b"),
    ("dokumentiert_sich", r"(?iu)\bdokumentier(t|en)\s+sich\b"),
    ("rekonstruiert_sich", r"(?iu)\brekonstruier(t|en)\s+sich\b"),
    ("kommt_zum_ausdruck", r"(?iu)\bkommt\s+zum\s+Ausdruck\b"),
    ("tritt_hervor", r"(?iu)\btritt(\s+(deutlich|klar))?\s+hervor\b"),
    ("zusammenfassend", r"(?iu)\b(zusammenfassend|abschließend|resümierend)\b"),
    ("material_referenz", r"\bim\s+(Sample|Material|Korpus|Datenmaterial|Fall|Beispiel)\b"),
    ("wird_ersichtlich", r"(?iu)\bwird\s+(ersichtlich|sichtbar|erkennbar)\b"),
)
# Markers of research questions.
QUESTIONS = (
    r"\?",
    r"(?iu)\b(forschungs|untersuchungs|leit|haupt)?frage(stellung)?\b",
    r"(?iu)\blautet\s*[:„\"]",
    r"(?iu)\b(diese|vorliegende)\s+(arbeit|studie|untersuchung|beitrag|aufsatz)\s+(untersucht|fragt|prüft|zeigt|analysiert|geht|widmet|setzt|ist)",
    r"(?iu)\b(im|zu(m)?)\s+(mittelpunkt|zentrum)\s+(steht|stehen)\b",
    r"(?iu)\b(soll|sollen|wird|werden)\s+\S+(\s+\S+){0,8}\s+(untersucht|geprüft|gezeigt|gefragt|analysiert|beantwortet)",
    r"(?iu)\b(erkenntnisinteresse|forschungsinteresse|untersuchungsgegenstand)\b",
)
# Markers of methods.
METHODS = (
    r"(?iu)\b(methodisch|methode(n|nlehre|nwahl)?|methodologie|methodologisch)\b",
    r"(?iu)\b(vorgehen|vorgehensweise|verfahren|untersuchungsdesign|forschungsdesign)\b",
    r"(?iu)\b(qualitativ|quantitativ|hermeneutisch|interpretativ|rekonstruktiv)\b",
    r"(?iu)\b(diskursanalys|inhaltsanalys|sequenzanalys|sequentiell|grounded\s+theory|phänomenolog)",
    r"(?iu)\b(vergleich(en|end)?|kontrast|gegenüberstellung|fallstudie|fallanalys|fallvergleich)",
    r"(?iu)\b(korpus|erhebung|stichprobe|sample|feld(forschung)?|interview|fragebogen|teilnehmend)",
    r"(?iu)\b(auswertung(s)?|kategorienbasiert|kodier|kodieren|gütekriteri)",
    r"(?iu)\b(triangulation|theoretical\s+sampling|inhaltsanalytisch)",
)
# Markers of a plan in sequence, each with what a hit counts (the match and its groups).
SEQUENCE = (
    (r"(?iu)\bim\s+(ersten|zweiten|dritten|vierten|letzten)\s+(teil|kapitel|abschnitt|schritt)\b", 3),
    (r"(?iu)\b(zunächst|zuerst|anschließend|danach|abschließend|schließlich|im\s+folgenden|sodann|sodass)\b", 2),
    (r"(?iu)\bdarauf(hin|\s+aufbauend)?\b", 2),
    (r"(?iu)\b(zum\s+abschluss|am\s+ende\s+der\s+arbeit|im\s+letzten)\b", 2),
)
# Markers of a plan's structure.
STRUCTURE = (
    r"(?iu)\bdie\s+arbeit\s+(gliedert\s+sich|ist\s+gegliedert|besteht\s+aus|umfasst|setzt\s+sich\s+zusammen)\b",
    r"(?iu)\b(aufbau|gliederung|struktur)\s+(dieser|der\s+vorliegenden)\s+arbeit\b",
    r"(?iu)\bim\s+folgenden\s+wird\b",
    r"(?iu)\b(in\s+kapitel|im\s+kapitel)\s+\d+\b",
)


def _form(pattern: str) -> str:
    """Edges of words among ASCII letters, digits and low lines, which ``\\b`` of
    Java is not; every pattern here begins and ends words with such letters."""
    opens = re.sub(r"(^|\(\?iu\)|\s)\\b", r"\1(?<![A-Za-z0-9_])", pattern)
    return opens.replace(r"\b", "(?![A-Za-z0-9_])")


def _literals(parsed) -> list[str] | None:
    """Words of which every match of a parsed pattern has one; None if there is no telling."""
    best, run = None, ""

    def better(found: list[str] | None) -> None:
        nonlocal best
        if found and min(map(len, found)) >= 2 and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, value in [*parsed, (None, None)]:
        if str(op) == "LITERAL":
            run += chr(value)
            continue
        better([run])
        run = ""
        if str(op) == "SUBPATTERN":
            better(_literals(value[3]))
        elif str(op) == "BRANCH":
            each = [_literals(x) for x in value[1]]
            better([x for y in each for x in y] if all(each) else None)
        elif str(op) == "MAX_REPEAT" and value[0] > 0:
            better(_literals(value[2]))
    return best


def _hit(text: Column, low: Column, pattern: str) -> Column:
    """Is there a match?  Where case does not matter the text is read in lower
    case (``low``), which is much faster than to fold it letter by letter; and
    a pattern is only tried where one of the words is that each match has."""
    if pattern.startswith("(?iu)"):
        text, pattern = low, re.sub(r"(?<!\\)[A-ZÄÖÜ]", lambda m: m[0].lower(), pattern.removeprefix("(?iu)"))
    strict = text.rlike(_form(pattern))
    words = _literals(re._parser.parse(pattern))
    return reduce(or_, [text.contains(x) for x in dict.fromkeys(words)]) & strict if words else strict


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    def some(low: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | _hit(text, low, p)
        return out

    return let(F.lower(text), some)


def heading_type(text: Column) -> Column:
    """struct(type, granularity, confidence) of a heading, null if no rule matches."""

    def first(low: Column) -> Column:
        out = F.lit(None).cast("struct<type:string,granularity:string,confidence:double>")
        for pattern, kind, confidence in reversed(HEADING_RULES):
            out = F.when(_hit(text, low, f"(?iu){pattern}"), F.struct(F.lit(kind).alias("type"), F.lit(GRANULARITY[kind]).alias("granularity"), F.lit(confidence).alias("confidence"))).otherwise(out)
        return out

    return let(F.lower(text), first)


def granularity(kind: Column, level: Column) -> Column:
    """How much of a work a heading of a type and level stands for."""
    own = F.element_at(F.create_map(*[F.lit(x) for kv in GRANULARITY.items() for x in kv]), kind)
    other = F.when(own == "UNTERKAPITEL", "UNTERKAPITEL").otherwise("KAPITEL")
    return F.when(own.isNotNull() & (kind != "WERK_STRUKTUR"), F.when(level <= 3, other).otherwise("ABSCHNITT"))


def hotspots(paragraphs: DataFrame, container: str = "container", text: str = "content") -> DataFrame:
    """Paragraphs with markers of findings, their number, and ``ratio``: the
    share of such paragraphs in their container."""
    p = paragraphs.withColumn("n_markers", F.size(findings(F.col(text)))).drop(text)
    share = p.groupBy(container).agg((F.count_if(F.col("n_markers") > 0) / F.count("*")).alias("ratio"))
    return p.where("n_markers > 0").join(share, container)


def findings(text: Column) -> Column:
    """array<struct<name, matched>> of the markers that a text has."""
    one = lambda low, n, p: F.when(_hit(text, low, p), F.struct(F.lit(n).alias("name"), F.regexp_extract(text, _form(p), 0).alias("matched")))
    return F.filter(let(F.lower(text), lambda low: F.array(*[one(low, n, p) for n, p in FINDINGS])), lambda h: h.isNotNull())


def is_question(text: Column) -> Column:
    return _any(text, QUESTIONS)


def is_method(text: Column) -> Column:
    return _any(text, METHODS)


def plan(text: Column) -> Column:
    """struct(hits, is_plan): three counted hits in sequence, or one with structure."""

    def counted(low: Column) -> Column:
        hits = F.lit(0)
        for p, n in SEQUENCE:
            hits = hits + F.when(_hit(text, low, p), n).otherwise(0)
        return hits

    hits, built = let(F.lower(text), counted), _any(text, STRUCTURE)
    return F.struct((hits + built.cast("int")).alias("hits"), ((hits >= 3) | built & (hits >= 1)).alias("is_plan"))
