"""Line-first cleaning, in DataFrame functions only.

Each line is held against rules for punctuation, fragments, navigation and boilerplate in four languages; lines that fail go. A document that loses too
much of its text that way, or fails the base rules on words and repetition, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of boilerplate lines and whole navigation lines, in English, German, French and Spanish (fixed values); matched without regard to case.
BOILERPLATE_PHRASES = [
    "all rights reserved", "cookie (?:policy|settings|preferences)", "privacy policy", "terms (?:of use|of service|and conditions)", "enable javascript", "lorem ipsum", "powered by", "unsubscribe", "click here", "sign up for",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "cookie-?(?:richtlinie|einstellungen)", "hier klicken", "newsletter abonnieren", "javascript aktivieren",
    "tous droits réservés", "politique de (?:confidentialité|cookies)", "mentions légales", "conditions (?:générales )?d.utilisation", "cliquez ici", "activer javascript", "se désabonner",
    "todos los derechos reservados", "política de (?:privacidad|cookies)", "términos (?:de uso|y condiciones)", "aviso legal", "haga clic aquí", "active javascript", "darse de baja",
]
NAVIGATION_LINES = [
    "home", "menu", "search", "log ?in", "log ?out", "sign ?in", "sign ?up", "register", "next", "previous", "prev", "back to top", "skip to (?:main )?content", "share", "tweet", "print", "read more", "contact(?: us)?", "about(?: us)?", "site ?map", r"page \d+(?: of \d+)?",
    "startseite", "menü", "suche", "anmelden", "abmelden", "registrieren", "weiter", "zurück", "nach oben", "teilen", "drucken", "mehr lesen", "kontakt", "über uns", r"seite \d+(?: von \d+)?",
    "accueil", "recherche", "connexion", "déconnexion", "suivant", "précédent", "haut de page", "partager", "imprimer", "lire la suite", "contactez-nous", "à propos", "plan du site",
    "inicio", "buscar", "iniciar sesión", "cerrar sesión", "siguiente", "anterior", "volver arriba", "compartir", "imprimir", "leer más", "contacto", "acerca de", "mapa del sitio",
]
BOILERPLATE = r"(?i)(?<![a-z])(?:" + "|".join(BOILERPLATE_PHRASES) + r")(?![a-z])"
NAVIGATION = r"(?i)^\W*(?:" + "|".join(NAVIGATION_LINES) + r")\W*$"
#: A line of fewer words than this that ends in no mark of TERMINAL is a fragment. Boilerplate is looked for in lines up to BOILERPLATE_CHARS.
FRAGMENT_WORDS, BOILERPLATE_CHARS = 4, 200
TERMINAL = ".!?…:;)]}\"'”’»。！？"
#: What isn't a letter or digit of a line: ASCII signs and common typographic ones.
MARKS = SPACE + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "\u00a0«»‹›“”„‚‘’–—…•·¡¿°"
#: Share of a line's items, at the least, that separators cut into menu entries.
SEPARATORS = "|»›•·"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text that isn't null."""
    bare = F.trim(text, F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated_words(words: Column, run: int = 5) -> Column:
    """How many words lie in a run of run words that stands in words more than once, the first time included."""

    def within(hashes: Column) -> Column:
        def covered(order: Column) -> Column:
            equal = lambda j: F.get(order, j)["h"]
            twice = F.filter(order, lambda e, j: ((j > 0) & (equal(j - 1) == e["h"])) | (equal(j + 1) == e["h"]))
            places = F.sort_array(F.transform(twice, lambda e: e["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-run).alias("at"))
            return F.aggregate(places, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(run), p - s["at"])).alias("n"), p.alias("at")), lambda s: s["n"])

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    def hashed(one: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(one) - run), lambda i: F.xxhash64(*[F.get(one, i + j) for j in range(run)]))
        return F.when(F.size(one) > run, let(runs, within)).otherwise(F.lit(0).cast("long"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def line_fails(line: Column) -> Column:
    """Whether a line with a word goes: hardly a letter in it, symbols through and through, a fragment without an end, a menu, or boilerplate.

    The costly tests come last and see only lines short enough for them.
    """

    def tests(x: Column) -> Column:
        letters, bare = F.length(F.translate(x, MARKS, "")), F.length(F.translate(x, SPACE, ""))
        entries = count_of(x, SEPARATORS)
        # Short of FRAGMENT_WORDS words, so that a line of ordinary length isn't split.
        fragment = (F.length(x) <= 60) & ~F.contains(F.lit(TERMINAL), F.right(x, F.lit(1))) & (F.size(F.split(x, r"[\x20\x09-\x0D]+")) < FRAGMENT_WORDS)
        return (
            (letters * 4 < bare)
            | (count_of(x, SYMBOLS) * 4 >= letters)
            | ((entries >= 3) & (entries * 24 >= letters))
            | fragment
            | ((F.length(x) <= 40) & x.rlike(NAVIGATION))
            | ((F.length(x) <= BOILERPLATE_CHARS) & x.rlike(BOILERPLATE))
        )

    return let(F.trim(line, F.lit(SPACE)), tests)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_share: float = 0.5, min_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """id, counts, n_lines, n_failed_lines, base_failed, kept and cleaned (the text without failed lines) for each row of docs.

    base_failed: under min_words words, or over most_repeated percent of them in repeated runs of five. kept: not that, and
    the lines that passed hold keep_share of the non-space characters at least. A null text counts as empty and isn't kept.
    Nothing is compared across rows, so equal rows and ids change nothing; texts may be of any length that a row holds.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0)
    rows = rows.select(
        "doc_id",
        "_t",
        let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))).alias("_w"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        count_of(t, SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.filter(x, lambda y: ~line_fails(y)).alias("good"))).alias("_l"),
    )
    rows = rows.select(
        "doc_id",
        F.col("_w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.dup").alias("n_dup_lines"),
        F.col("_w.repeated").alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"),
        (F.col("_l.n") - F.size("_l.good")).alias("n_failed_lines"),
        F.array_join("_l.good", "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    enough = F.length(F.translate("cleaned", SPACE, "")) >= F.col("word_chars") * keep_share
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & enough)
