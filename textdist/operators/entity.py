"""Entity facts: the relational core of the biography query, and its result document."""

from pyspark.sql import functions as F

from textdist.operators.joins import concat_distinct, first_per_key, lookup_join


def entity_facts(entities, badges, titles, occupations, labels, key, badge):
    """Featured entities with their optional title, label and joined occupations.

    ``entities`` holds the required facts (inner), ``badges`` the accepted list (semi),
    ``titles`` and ``labels`` are optional per entity (left), ``occupations`` is optional and
    many per entity; its language filter is part of the optional side. One row per entity,
    ordered by label.
    """
    featured = lookup_join(entities, badges, [badge], F.col(key), "left_semi")
    english = occupations.where(F.col("lang") == "en") if "lang" in occupations.columns else occupations
    joined = concat_distinct(english, [key], "occupation", "occupations")
    return (
        featured.join(titles, key, "left").join(labels, key, "left").join(joined, key, "left")
        .na.fill("", ["occupations"]).distinct().orderBy(*[c for c in labels.columns if c != key])
    )


def one_per_title(entities, title, order):
    """Rows with a title, the first per title in the given order."""
    return first_per_key(entities.where(F.col(title).isNotNull()), [title], order)
