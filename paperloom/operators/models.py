"""Adapters for models: narrow Arrow-batched calls, so a model is loaded once a worker."""

from __future__ import annotations

import time
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import ABSTAIN


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility characters folded, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.DoubleType())
def ink(pixels: pd.Series) -> pd.Series:
    """Share of dark pixels in 8-bit grey images; 0 for none."""
    import numpy as np

    return pixels.map(lambda b: float((np.frombuffer(b, np.uint8) < 200).mean()) if b else 0.0)


def dark_share(histogram: Column) -> Column:
    """The same from a histogram of 256 bins."""
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)
    dark = F.aggregate(F.slice(histogram, 1, 200), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(dark, total), F.lit(0.0))


def embedder(load):
    """A column function text -> unit vector. ``load()`` gives a callable on a list of texts."""
    cache: dict = {}

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        import numpy as np

        model = cache.setdefault("model", None) or cache.update(model=load()) or cache["model"]
        x = np.asarray(model(texts.fillna("").tolist()), np.float32)
        return pd.Series((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).tolist())

    return embed


def caption(images: DataFrame, load, retries: int = 1, wait: float = 2.0) -> DataFrame:
    """``page_id, caption, elapsed_sec, error`` for images (page_id, content); errors are rows, not failures."""

    def run(batches):
        model = load()
        for batch in batches:
            rows = []
            for page, content in zip(batch.column("page_id").to_pylist(), batch.column("content").to_pylist()):
                began, text, error = time.time(), "", None
                for attempt in range(retries + 1):
                    try:
                        text, error = model(content), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                        if attempt < retries:
                            time.sleep(wait)
                rows.append({"page_id": page, "caption": text, "elapsed_sec": round(time.time() - began, 2), "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.string()), ("caption", pa.string()), ("elapsed_sec", pa.float64()), ("error", pa.string())]))

    return images.select("page_id", "content").mapInArrow(run, "page_id string, caption string, elapsed_sec double, error string")


def caption_missing(spark, pages: DataFrame, log: str, load, parts: int = 16, **options) -> DataFrame:
    """Caption the image pages (id, route, image) that the log at ``log`` has no caption of, and log what was made; the report of this call.

    Each call takes only what is missing, so a call that was cut off, or pages whose model call failed, are taken up by the
    next one. The images of pages that are done aren't read. The report: pages wanted, captioned, failed, mean and 95th percentile of seconds.
    """
    from paperloom.operators.evaluate import caption_report, not_done
    from paperloom.session import kept
    from paperloom.sources import readers, writers

    wanted = pages.filter("route = 'image'").select(F.col("id").alias("page_id"), F.col("image").alias("content"))
    if readers.exists(spark, log):
        wanted = not_done(wanted, readers.captions(spark, log), "page_id")
    made = kept(caption(wanted.repartition(parts), load, **options), "captioned")  # a model call isn't made twice
    writers.append_captions(made.select("page_id", "caption", "elapsed_sec"), log)
    return caption_report(made)


#: What an answer model is told, in our own words; an adapter may send another text.
SYSTEM = f"아래 문서만 근거로 답한다. 근거가 없으면 '{ABSTAIN}.' 한 문장으로 답하고, 근거가 있으면 그 문장을 쓰지 않는다. 끝에 출처를 적는다."


def prompts(packed: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, prompt, images, sources`` for all queries (qid, query) from packed contexts (qid, context, images, sources);
    the prompt of a query without any chunk is null."""
    user = F.concat(F.lit("질문: "), nfkc("query"), F.lit("\n\n참고 문서:\n"), nfkc("context"))
    none = F.array().cast("array<string>")
    joined = queries.select("qid", "query").join(packed.select("qid", "context", "images", "sources"), "qid", "left")
    return joined.select("qid", F.when(F.size(F.coalesce("sources", none)) > 0, user).alias("prompt"), F.coalesce("images", none).alias("images"), F.coalesce("sources", none).alias("sources"))


def answer(prompts: DataFrame, load, least: int = 40, attempts: int = 2, strict: bool = False, image_most: int = 2) -> DataFrame:
    """``qid, answer, retried, error, degenerate`` for prompts (qid, prompt, images).

    ``load()`` gives a callable on a prompt and ``image_most`` images at most; where it has a method
    ``restart``, that is called after a degenerate output, and the prompt is sent again, ``attempts``
    times in all. If none is usable the answer is null with an error, or, if ``strict``, the job fails.
    A null prompt isn't sent: nothing was found, and the answer says so.
    """
    from paperloom.functions.text import degenerate, without_abstention

    def run(batches):
        model = load()
        for batch in batches:
            rows = []
            for qid, prompt, images in zip(*(batch.column(c).to_pylist() for c in ("qid", "prompt", "images"))):
                text, tries, error = f"{ABSTAIN}.", 0, None
                while prompt is not None:
                    text, tries = model(prompt, (images or [])[:image_most]), tries + 1
                    if not _degenerate(text):
                        break
                    if hasattr(model, "restart"):
                        model.restart()
                    if tries == attempts:
                        error = f"degenerate output after {attempts} attempts"
                        if strict:
                            raise RuntimeError(f"query {qid}: {error}")
                        text = None
                        break
                rows.append({"qid": qid, "answer": text, "retried": tries > 1, "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("qid", pa.int64()), ("answer", pa.string()), ("retried", pa.bool_()), ("error", pa.string())]))

    out = prompts.select(F.col("qid").cast("long").alias("qid"), "prompt", "images").mapInArrow(run, "qid long, answer string, retried boolean, error string")
    return out.withColumn("degenerate", F.coalesce(degenerate(F.col("answer")), F.lit(True))).withColumn("answer", without_abstention(F.col("answer"), least))


def health(ping) -> bool:
    """Whether a model's server answers; ``ping()`` may raise."""
    try:
        ping()
        return True
    except Exception:  # noqa: BLE001
        return False


def _degenerate(text: str) -> bool:
    s = text.strip()
    return len(s) >= 8 and (len(set(s)) <= 2 or max(map(s.count, set(s))) / len(s) > 0.8)
