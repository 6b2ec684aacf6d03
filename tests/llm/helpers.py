"""Small tables for the operator tests."""
import public_tokenizers
from tokenizers import Tokenizer

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")

ODD = ["", None, " ", "\n\n \t", "That it.", "That it.", "It's l'été — ½ ²³ ÀÉß ªº µ", "a\x1cb\x1f c\x85d\xa0e  f 　g",
       "<|endoftext|>x<|startoftext|> <|endoftext|>", "İstanbul ΣΑΣ e\u0301 \u0301x नमस्ते 你好 🙂🙂", "x" * 3000, "12345 67,8.9!!! don't we'll 'S",
       "foo\n bar\n\n  baz \n \nqux \r\n end  ", "word " * 4000]


def docs_of(spark, texts, first=0, extra=True):
    """documents-like rows with a null id, a repeated row and clashing extra columns."""
    rows = [(i + first, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    if extra:
        rows += [(None, "null id text", None, None, None), rows[-1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def with_clashes(docs):
    """Extra columns under names the operators use themselves."""
    from pyspark.sql import functions as F
    names = ["length", "start", "ids", "block", "n_tokens", "shard", "score", "node", "shingles", "spans", "anchor", "token", "_tie"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def key(row):
    return (row[0] is not None, row[0] or 0, *map(str, row[1:]))


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"
