"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the columns of documents,
whatever their names. Null texts count as empty; very long texts are worked on whole; of repeated rows one stays; empty tables give empty
results.
"""

from lodestone.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from lodestone.llm.common import cut, documents, fresh, spent

#: Words whose ids a task of the packing remembers and characters it works on at once: fewer than in op10, as a worker keeps its words for
#: as long as it lives, beside what the other stages need.
REMEMBER, AT_ONCE = 100_000, 1 << 20


def drop_toxic(spark, docs, sf_dir):
    """Without the rows that the lexicon, learned from ``labels``, predicts as toxic. An empty text is not toxic; ties are not possible."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark, docs, sf_dir):
    """One row of each group of texts that are equal without white space: the longest, then the one of the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One row of each class of near copies: the one of the smallest doc_id. Texts without words are one class."""
    return near_dedup.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """All rows, in the order of the mixing schedule. A null source is a source of its own; rows that agree in id and text may swap."""
    return mixing.mixed(docs)


def pack_sequences(spark, docs, sf_dir):
    """A row per piece of each text and its place in a sequence; sequences follow the mixed order, which files do not keep."""
    (order,) = fresh(docs.columns, "m_order")
    return packing.pack(mixing.with_order(docs, order), "word_bpe_49k.json", order=order, remember=REMEMBER, at_once=AT_ONCE)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can express neither a learned lexicon nor a tokenizer; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; what a stage wrote goes when the next has written."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            spent(last)
    return docs
