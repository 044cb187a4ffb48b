"""The shared first part of every report: clean, decode, link."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from contactscope.operators.clean import real_contacts
from contactscope.operators.link import contacts_per_order, with_contact_counts
from contactscope.sources.tables import materialise


@dataclass
class Linked:
    """Raw tables, real contacts with decoded keys, orders with contact counts."""

    raw_orders: DataFrame
    raw_contacts: DataFrame
    contacts: DataFrame
    orders: DataFrame
    counts: DataFrame


def prepare(
    orders: DataFrame, contacts: DataFrame, strict: bool = False, store: bool = False
) -> Linked:
    """Link once for all reports.

    With ``store`` the cleaned contacts and the linked orders are written to the
    shared folder, so that each report is a scan of the columns it needs instead of
    another decode and join.
    """
    real = real_contacts(contacts, strict)
    if store:
        real = materialise(real, "contacts")
    linked = with_contact_counts(orders, real)
    if store:
        linked = materialise(linked, "orders")
    return Linked(orders, contacts, real, linked, contacts_per_order(real))
