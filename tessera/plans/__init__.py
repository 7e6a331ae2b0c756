"""Queries over the generated tables; importing this package registers them."""

from tessera.plans import encoders, evaluation, intents, models, pieces, places, retrieval, texts  # noqa: F401
