"""Families from names and labels, and how the two agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import let, spaced_key

#: Names of methods as they appear in results.
INVALID = "Revisar: descripción inválida"
CONFLICT = "Revisar: conflicto"
HIGH, BY_NAME, BY_NAME_GENERIC, BY_LABEL, BY_TYPE, NO_RULE = "Alta confianza", "Por nombre", "Por nombre (etiqueta genérica)", "Por etiqueta", "Por tipo", "Revisar: sin regla"
AUTOMATIC = (HIGH, BY_NAME, BY_NAME_GENERIC, BY_LABEL, BY_TYPE)


def families_of_name(name: Column, pack) -> Column:
    """All families whose pattern is found, in rule order; one overriding family wins alone; a fallback if none."""
    hits = let(spaced_key(name), lambda k: F.array_compact(F.array(*[F.when(k.rlike(p), F.lit(f)) for f, p in pack.family_patterns], *_fallback(k, pack))))
    for winner in pack.overriding:
        hits = let(hits, _prefer(winner))
    # the fallback counts only where nothing else was found
    return let(hits, lambda h: F.when(F.size(h) > 1, F.filter(h, lambda x: ~x.startswith(_LAST))).otherwise(F.transform(h, lambda x: F.regexp_replace(x, "^" + _LAST, ""))))


_LAST = "\x01"


def _prefer(family: str):
    return lambda h: F.when(F.array_contains(h, family), F.array(F.lit(family))).otherwise(h)


def _fallback(key: Column, pack) -> list[Column]:
    return [F.when(key.rlike(pack.fallback[1]), F.lit(_LAST + pack.fallback[0]))] if pack.fallback else []


def families_of_labels(labels: Sequence[Column], aliases: Mapping[str, str]) -> Column:
    """Distinct families of labels by their spaced key, sorted."""
    table = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv])
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.try_element_at(table, spaced_key(c)) for c in labels]))))


def combine(name: Column, by_name: Column, by_label: Column, generic: Sequence[str], product_type: Column, package: Column, bundle: str, staff: str) -> Column:
    """``struct(family, method)`` by the decision table: the order of the branches is the rule."""
    n, e = F.try_element_at(by_name, F.lit(1)), F.try_element_at(by_label, F.lit(1))
    n_ok, e_ok = F.size(by_name) == 1, F.size(by_label) == 1
    none = F.lit(None).cast("string")
    out = lambda family, method: F.struct(family.alias("family"), method.alias("method"))
    text = lambda *parts: F.concat(F.lit(CONFLICT + " ("), *parts, F.lit(")"))
    return (
        F.when(name.isNull(), out(none, F.lit(INVALID)))
        .when(F.size(by_name) > 1, out(none, text(F.array_join(by_name, "/"))))
        .when(n_ok & e_ok & (n == e), out(n, F.lit(HIGH)))
        .when(n_ok & e_ok & e.isin(*generic) & ~n.isin(*generic), out(n, F.lit(BY_NAME_GENERIC)))
        .when(n_ok & e_ok & (n == bundle), out(e, F.lit(BY_LABEL)))
        .when(n_ok & e_ok, out(none, text(n, F.lit(" / "), e)))
        .when((package == "PACKAGE") & ~n_ok & ~e_ok, out(F.lit(bundle), F.lit(BY_TYPE)))
        .when(n_ok, out(n, F.lit(BY_NAME)))
        .when(e_ok, out(e, F.lit(BY_LABEL)))
        .when(F.size(by_label) > 1, out(none, text(F.array_join(by_label, "/"))))
        .when(product_type == "LABOR", out(F.lit(staff), F.lit(BY_TYPE)))
        .otherwise(out(none, F.lit(NO_RULE)))
    )


#: Statuses and reasons of the conservative review, and the names of what waits.
APPROVED, PENDING, QUARANTINED, BY_PERSON, REFUSED = "approved_by_rule", "pending", "quarantined", "approved_by_reviewer", "rejected"
AGREE, NAME_ONLY, LABEL_ONLY, UNCLEAR = "Objeto principal y etiqueta especifica coinciden", "Descripcion sugiere familia; etiquetas ausentes o distintas", "Solo etiqueta: descripcion requiere revision", "Evidencias ambiguas o contradictorias"
SOURCE_PENDING = "Validacion de origen pendiente"
PACKAGE_NOTE, WARNING_NOTE, TYPE_NOTE, MASTER_NOTE = "; validar composicion del paquete", "; advertencia operacional", "; validar tipo de servicio/repuesto/cargo", "; maestro existente requiere aprobacion explicita"
WAITING = ("Cuarentena", "Paquetes", "Advertencias operacionales", "Servicios, repuestos o cargos", "Evidencia contradictoria", "Familia propuesta por confirmar", "Sin familia suficiente")


def review(quarantine: Column, lexical: Column, labels: Column, package: Column, product_type: Column, warning: Column, has_master: Column | None = None) -> Column:
    """Conservative review ``struct(family, status, reason)``: approved only where both kinds of evidence name one family.

    Packages, operational warnings and other types than ITEM go back to pending,
    and so does what has a master already.
    """
    name, label = F.try_element_at(lexical, F.lit(1)), F.try_element_at(labels, F.lit(1))
    one_l, one_g = F.size(lexical) == 1, F.size(labels) == 1
    agree = one_l & one_g & (name == label)
    is_package, odd_type = F.coalesce(package == "PACKAGE", F.lit(False)), ~F.coalesce(product_type == "ITEM", F.lit(False))
    warned = F.coalesce(warning, F.lit(False))
    held = F.coalesce(has_master, F.lit(False)) if has_master is not None else F.lit(False)
    clean_ = agree & ~is_package & ~warned & ~odd_type
    reason = F.concat(
        F.when(agree, AGREE).when(one_l, NAME_ONLY).when(one_g, LABEL_ONLY).otherwise(UNCLEAR),
        F.when(is_package, PACKAGE_NOTE).otherwise(""), F.when(warned, WARNING_NOTE).otherwise(""), F.when(odd_type, TYPE_NOTE).otherwise(""), F.when(clean_ & held, MASTER_NOTE).otherwise(""),
    )
    open_ = F.struct(F.when(one_l, name).when(one_g, label).alias("family"), F.when(clean_ & ~held, APPROVED).otherwise(PENDING).alias("status"), reason.alias("reason"))
    return F.when(F.coalesce(quarantine, F.lit(False)), F.struct(F.lit(None).cast("string").alias("family"), F.lit(QUARANTINED).alias("status"), F.lit(SOURCE_PENDING).alias("reason"))).otherwise(open_)


def without_overridden(hits: Column, specific: str, generic: str) -> Column:
    """Families without ``generic`` where ``specific`` was found too."""
    return F.when(F.array_contains(hits, specific), F.array_remove(hits, generic)).otherwise(hits)


def with_history(decisions: DataFrame, history: DataFrame, code: str, order: Sequence[str]) -> DataFrame:
    """Pending ``decisions (code, family, status, reason)`` under their newest earlier proposal ``(code, field, value, version)``.

    A proposed family is kept as the family to confirm; a proposal of a category
    alone takes the family away.
    """
    newest = history.groupBy(code).agg(F.max_by(F.struct("field", "value", "version"), F.struct(*order)).alias("_h"))
    met = decisions.join(newest, code, "left")
    waits = (F.col("status") == PENDING) & F.col("_h").isNotNull()
    family = waits & (F.col("_h.field") == "family") & F.col("_h.value").isNotNull()
    category = waits & (F.col("_h.field") == "category")
    kept = F.concat(F.lit("Propuesta previa mas reciente conservada ("), F.col("_h.version"), F.lit("); no cumple aprobacion automatica"))
    return met.withColumns({
        "family": F.when(family, F.col("_h.value")).when(category, F.lit(None)).otherwise(F.col("family")),
        "reason": F.when(family, kept).when(category, "Revision previa permite solo categoria; familia pendiente").otherwise(F.col("reason")),
    }).drop("_h")


#: Methods of decisions that people made.
BY_REVIEWER, BY_REJECTION, REOPENED, BY_HAND = "Revisor", "Revisar: rechazada por revisor", "Revisar: reabierta por revisor", "Alta manual"


def decide(reviewer: Column, reviewed_family: Column, origin: Column, own_family: Column, automatic: Column) -> Column:
    """People outrank rules: an approving or rejecting reviewer, then a manual origin, then the rules."""
    out = lambda family, method: F.struct(family.alias("family"), F.lit(method).alias("method"))
    return (
        F.when(reviewer == "approved", out(reviewed_family, BY_REVIEWER))
        .when(reviewer == "rejected", out(F.lit(None).cast("string"), BY_REJECTION))
        .when(origin == "manual", out(own_family, BY_HAND))
        .otherwise(automatic)
    )


def pending_group(status: Column, reason: Column, n_lexical: Column, n_labels: Column, family: Column) -> Column:
    """Why an item waits: the first rule that holds."""
    low = F.lower(reason)
    return (
        F.when(status == QUARANTINED, WAITING[0])
        .when(low.contains("paquete"), WAITING[1])
        .when(low.contains("advertencia"), WAITING[2])
        .when(low.contains("tipo de"), WAITING[3])
        .when((n_lexical > 1) | (n_labels > 1), WAITING[4])
        .when(family.isNotNull(), WAITING[5])
        .otherwise(WAITING[6])
    )


def written_back(reviews: DataFrame, products: DataFrame, version: str, code: str = "code") -> DataFrame:
    """Conservative ``reviews`` that wait or that a rule approved, with the family and method that the rules gave their ``products (code, family, method)``.

    A sure method approves, any other waits; quarantined reviews and those that a
    person decided stay, also where the product shows that decision.
    """
    said = products.select(code, F.col("family").alias("_family"), F.col("method").alias("_method"))
    touched = F.col("_method").isNotNull() & ~F.col("_method").isin(BY_REVIEWER, BY_REJECTION) & F.col("status").isin(PENDING, APPROVED)
    change = {"family": F.col("_family"), "status": F.when(F.col("_method") == HIGH, APPROVED).otherwise(PENDING), "reason": F.concat(F.lit(f"{version}: "), F.col("_method"))}
    return reviews.join(said, code, "left").withColumns({c: F.when(touched, v).otherwise(F.col(c)) for c, v in change.items()}).select(*reviews.columns)


def with_decisions(reviews: DataFrame, decisions: DataFrame, key: str = "master_id") -> DataFrame:
    """Reviews under what people decided of their products (``decision, reviewed_family``): an approval or a rejection replaces status and family."""
    met = reviews.join(decisions.select(key, "decision", "reviewed_family"), key, "left")
    approved, rejected = F.col("decision") == "approved", F.col("decision") == "rejected"
    status = F.when(approved, BY_PERSON).when(rejected, REFUSED).otherwise(F.col("status"))
    family = F.when(approved, F.col("reviewed_family")).when(~F.coalesce(rejected, F.lit(False)), F.col("family"))
    return met.withColumns({"family": family, "status": status}).select(*reviews.columns)
