import pytest
from pyspark.sql import functions as F

WORDS = "the cat sat on a mat and then it ran off into the long dark night with a red hat".split()


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder that a cluster would name."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


ODD_TEXTS = [
    None, "", " ", "\n\n", "one", "two words", "a b c", "a b c", "A B C", "\t tab\x0b\x0cfeed\r\n",
    "é 𝄞 中文 ß", "x" * 70000, "same " * 300, "# $ % | < > &" * 20,
    " ".join(WORDS * 5), " ".join(WORDS * 5), " ".join(WORDS * 5 + ["end"]), " ".join(WORDS[:-1]) + "\n" + " ".join(WORDS),
    "<|endoftext|> and white　space   runs  \n \t x", "mail a.b@c.de, ip 1.2.3.4 card 4111 1111 1111 1111 call +1 (555) 010-4477!",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, repeated rows, a null id, and columns named like the operators' own."""
    rows = [(i, t, None if i % 3 else "en", i, "r", "s") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[14], rows[7], (None, "null id here", "en", None, "r", "s")]
    schema = "doc_id long, text string, lang string, n_words long, row string, fp string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where(F.lit(False))
