"""Expressions of embedding and reranking calls."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..errors import ProviderError

#: Inputs an embedding request takes.
REQUEST_CAPS = {"openai": 2048, "cohere": 96, "tei": 32}
#: Names of input types on the wire.
COHERE_TYPES = {"query": "search_query", "document": "search_document", "classification": "classification", "clustering": "clustering"}
JINA_TASKS = {"query": "retrieval.query", "document": "retrieval.passage"}
#: Categories of HTTP statuses; other statuses are provider_unavailable.
STATUS_CATEGORIES = {
    "provider_authentication": (401, 403),
    "provider_rate_limit": (429,),
    "provider_invalid_model": (404,),
    "provider_invalid_request": (400, 422),
}
#: Error codes of a refused content block.
REFUSED_BLOCK_CODES = ("image_content_not_supported", "unsupported_image_media_type", "audio_content_not_supported", "video_content_not_supported", "unsupported_content_block")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0.0 where either norm is 0."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    na, nb = (F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))) for v in (a, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (na * nb))


def normalized_base_url(url: str, prefix: str = "/v1") -> str:
    """A host root without trailing slashes; one that ends in the version is refused."""
    root = url.rstrip("/")
    if root.endswith(prefix):
        raise ValueError(f"{url} ends in {prefix}, which the routes add")
    return root


def base_url(url: Column) -> Column:
    """The same for a column; refused_base_url says which are refused."""
    return F.rtrim(url, F.lit("/"))


def refused_base_url(url: Column, prefix: str = "/v1") -> Column:
    return base_url(url).endswith(prefix)


def prefixed(text: Column, input_type: Column, query: str | None, document: str | None) -> Column:
    """Client-side prefixes by input type; other types get none."""
    p = F.when(input_type == "query", F.lit(query)).when(input_type == "document", F.lit(document))
    return F.concat(F.coalesce(p, F.lit("")), text)


def wire_type(input_type: Column, names: Mapping[str, str], absent: str | None) -> tuple[Column, Column]:
    """The wire's name of an input type, and whether it is refused."""
    out = F.when(input_type.isNull(), F.lit(absent))
    for k, v in names.items():
        out = out.when(input_type == k, F.lit(v))
    return out, input_type.isNotNull() & ~input_type.isin(*names)


def counter(token: Column) -> Column:
    """A JSON token that is a whole number of 0 or more, else null: no strings, no fractions."""
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("long"))


def extras_union(base: Column, extra: Column) -> Column:
    """base as it is, then what extra adds, each once, in order."""
    return F.concat(base, F.array_except(F.array_distinct(extra), base))


def managed_extras(body: Mapping[str, object], extras: Mapping[str, object], managed: Mapping[str, str], defaults: Mapping[str, object] | None = None) -> dict:
    """A request body with the caller's extras; managed keys are merged or must be equal."""
    out, defaults = dict(body), defaults or {}
    for key, value in extras.items():
        arm = managed.get(key)
        if arm is None:
            if key in body:
                raise ValueError(f"{key} is produced but not managed")
            out[key] = value
        elif arm == "merge":
            if isinstance(value, (list, tuple, str)) and value:
                have = defaults.get(key, out.get(key))
                have = list(have) if isinstance(have, (list, tuple)) else [] if have is None else [have]
                more = [value] if isinstance(value, str) else list(value)
                out[key] = have + [x for x in dict.fromkeys(more) if x not in have]
        elif defaults.get(key, out.get(key)) != value:
            raise ProviderError("provider_invalid_request", f"{key} is managed and can't be set to another value", key)
    return out


def echo_text(kind: Column, value: Column) -> Column:
    """A reranked document: a string as it is, an object's text, null for null."""
    return F.when(kind == "string", value).when(kind == "object", F.get_json_object(value, "$.text"))


def http_category(status: Column, vendor: str = "openai", code: Column | None = None, kind: Column | None = None, message: Column | None = None) -> Column:
    """The error category of an HTTP status; for completions (vendor "completion") the body
    refines 400, 404 and 503."""
    code, kind, message = (x if x is not None else F.lit(None).cast("string") for x in (code, kind, message))
    out = F.when(F.lit(False), F.lit(""))
    if vendor == "completion":
        low_code, low_kind, low = F.lower(code), F.lower(kind), F.lower(message)
        media = "image|audio|video"
        refused = (
            code.isin(*REFUSED_BLOCK_CODES)
            | (low_code.rlike(media) & low_code.rlike("not_supported|unsupported"))
            | low_kind.isin("image_parse_error", "image_content_not_supported")
            | (low.contains("does not support") & low.rlike(media))
        )
        no_model = (code == "model_not_found") | (low_kind.contains("model") & low_kind.contains("found"))
        loading = (kind == "model_not_loaded") | low.contains("not loaded") | low.contains("loading")
        yes = lambda c: F.coalesce(c, F.lit(False))
        out = (
            out.when(status.isin(401, 403), "provider_authentication")
            .when((status == 400) & yes(refused), "provider_unsupported_content_block")
            .when(status == 400, "provider_invalid_request")
            .when((status == 404) & yes(no_model), "provider_invalid_model")
            .when(status == 429, "provider_rate_limit")
            .when((status == 503) & yes(loading), "provider_model_not_loaded")
        )
    else:
        for category, statuses in STATUS_CATEGORIES.items():
            extra = (413,) if vendor == "tei" and category == "provider_invalid_request" else ()
            out = out.when(status.isin(*statuses, *extra), category)
    return out.otherwise("provider_unavailable")


def retry_after(value: Column) -> Column:
    """Seconds; HTTP dates give null."""
    return F.trim(value).try_cast("double")


@F.pandas_udf(ArrayType(FloatType()))
def _decode(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None or not len(b) or len(b) % 4 else np.frombuffer(b, "<f4"))


def decoded_vector(text: Column) -> Column:
    """A base64 text of little-endian 32-bit floats; null unless whole and not empty."""
    return _decode(F.try_to_binary(text, F.lit("base64")))


def stitched(responses: Sequence[Mapping], cap: int) -> dict:
    """One response from consecutive chunks of at most cap inputs (for a client on the driver).

    Usage is the sum only if every chunk reports it; id and model are the first chunk's.
    """
    vectors: list = []
    for k, r in enumerate(responses):
        if len(r["vectors"]) > cap or (k + 1 < len(responses) and len(r["vectors"]) != cap):
            raise ProviderError("provider_invalid_response", f"chunk {k} has {len(r['vectors'])} vectors")
        vectors += r["vectors"]
    if len({len(v) for v in vectors}) > 1:
        raise ProviderError("provider_invalid_response", "vectors differ in length")
    used = [r.get("tokens") for r in responses]
    return {"id": responses[0].get("id"), "model": responses[0].get("model"), "vectors": vectors, "tokens": None if None in used else sum(used)}
