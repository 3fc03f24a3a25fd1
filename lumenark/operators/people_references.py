"""People whom questions refer to: names from a table of any size, found among the words of all questions at once.

The words of a question are cut once, in normal form. Runs of up to ``LONGEST`` words are joined with the names, so the table of
names may hold as many as it likes and neither side is looped over. The few words around a run are looked at where it is cut,
so that what is joined of it is the run and one flag: they tell whether the person is to be absent (a negation among the
three words before, or a trailing one among the three behind), or whether a first person only tells who took the picture (a
verb of capture among the four words behind) or who asks (``show me``). Mentions that contradict each other give both
clauses, so that nothing is found rather than too much. The work on a question grows with its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, nfkc
from .retrieval import TOKEN

LONGEST, NEGATION_WORDS, AUTHOR_WORDS = 3, 3, 4
# Well-known references, other words for the first person, and words that turn a reference.
REFERENCES = (
    "me", "myself", "wife", "husband", "spouse", "partner", "mother", "mom", "mum",
    "father", "dad", "brother", "sister", "child", "son", "daughter", "friend",
    "भैया", "भाई", "दीदी", "बहन", "पत्नी", "बीवी", "पति", "पप्पा", "पिता", "मम्मी", "माँ", "बेटा", "बेटी", "बच्चा",
)
FIRST_PERSON = ("i", "main", "mai", "मैं")
CAPTURE_VERBS = (
    "take", "takes", "taking", "took", "taken", "capture", "captures", "capturing", "captured", "shoot", "shoots", "shooting", "shot",
    "record", "records", "recording", "recorded", "save", "saves", "saving", "saved", "download", "downloads", "downloading", "downloaded",
    "scan", "scans", "scanning", "scanned", "create", "creates", "creating", "created", "receive", "receives", "receiving", "received",
)
REQUEST_VERBS = ("show", "find", "give", "display", "open", "locate")
CONTINUATIONS = (
    "and", "with", "wear", "wears", "wearing", "wore", "hold", "holds", "holding", "carry", "carries", "carrying", "use", "uses", "using",
    "stand", "stands", "standing", "sit", "sits", "sitting", "dance", "dances", "dancing", "run", "runs", "running",
)
NEGATIONS = ("not", "no", "without", "exclude", "excluding", "except", "बिना", "नहीं", "नही")
TRAILING_NEGATIONS = ("बिना", "bina")


def well_known(spark) -> DataFrame:
    """(name, person_id) of references that need no table."""
    return spark.createDataFrame([*((r, r) for r in REFERENCES), *((a, "me") for a in FIRST_PERSON)], "name string, person_id string")


def person_clauses(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(id, person_id, present): who must, or must not, be in what a question (id, text) asks for, by ``names`` (name, person_id)."""
    known = names.select(F.array_join(F.regexp_extract_all(nfkc(F.col("name")), F.lit(TOKEN), F.lit(0)), " ").alias("run"), "person_id").where("run <> ''").distinct()
    words = questions.select("id", F.regexp_extract_all(nfkc(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0)).alias("w"))
    cut = words.select("id", F.explode(let(F.col("w"), signed_runs)).alias("r")).where("r is not null")
    runs = cut.select("id", F.expr("substring(r, 2)").alias("run"), F.col("r").startswith("+").alias("present"))
    # Spark takes the runs to be as few as the questions, and would send them all through the driver to broadcast them.
    return runs.hint("merge").join(known, "run").select("id", "person_id", "present").distinct()


def signed_runs(words: Column) -> Column:
    """The distinct runs of the words, each behind ``+`` or, where a negation is near, ``-``; maybe a null among them.

    The words that turn a run are marked once for each place, and words are read by their place alone, as a slice copies the whole
    array. Runs are strings, as Spark compares each struct of an array with all others to find the distinct ones.
    """
    kind = lambda x: reduce(Column.__add__, [F.when(x.isin(*of), bit).otherwise(0) for of, bit in ((NEGATIONS, 1), (TRAILING_NEGATIONS, 2), (CAPTURE_VERBS, 4))])

    def near(kinds: Column) -> Column:
        """By place, and one behind the last: 1 for a negation before it; 2 for a trailing one, 4 for a verb of capture, from it on."""
        some = lambda places, bit: reduce(Column.bitwiseOR, [F.coalesce(F.get(kinds, i), F.lit(0)) for i in places]).bitwiseAND(F.lit(bit))
        one = lambda i: some([i - k for k in range(1, NEGATION_WORDS + 1)], 1) + some([i + k for k in range(NEGATION_WORDS)], 2) + some([i + k for k in range(AUTHOR_WORDS)], 4)
        return F.transform(F.concat(kinds, F.array(F.lit(0))), lambda _, i: one(i))

    def runs(around: Column) -> Column:
        has = lambda i, bit: F.get(around, i).bitwiseAND(F.lit(bit)) != 0

        def one(i: Column, n: int) -> Column:
            """The run of n words from a place on; null if the words end before it does, or if it names nobody."""
            sign = F.when(has(i, 1) | has(i + n, 2), "-").otherwise("+")
            run = F.concat(sign, F.get(words, i), *[x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))])
            if n > 1:
                return run
            word = F.get(words, i)
            author = word.isin(*FIRST_PERSON) & has(i + 1, 4)
            recipient = (word == "me") & F.coalesce(F.get(words, i - 1), F.lit("")).isin(*REQUEST_VERBS) & ~F.coalesce(F.get(words, i + 1), F.lit("")).isin(*CONTINUATIONS)
            return F.when(~author & ~recipient, run)

        of_length = lambda n: F.transform(words, lambda _, i: one(i, n))
        return F.array_distinct(F.concat(*map(of_length, range(1, LONGEST + 1))))

    return let(let(F.transform(words, kind), near), runs)
