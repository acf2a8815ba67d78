"""The files that a filter offers: each frame, how missing values are written, and its name, tied together."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import FilterSpec, filter_orders, filter_plants, filter_shipping
from ..sources import export
from . import service, shipping, warehouse


@dataclass(frozen=True)
class Export:
    """A frame under the name of its file. A guarded one refuses to be written without rows and leaves missing values
    empty; the others are written as they are, with NA, and carry the time in their name."""

    name: str
    frame: DataFrame
    guarded: bool

    def file(self, now: datetime) -> str:
        return export.export_name(self.name, now, with_time=not self.guarded)


def exports_of(marts: Mapping[str, DataFrame], orders: DataFrame, spec: FilterSpec) -> list[Export]:
    """All exports under a filter: four of the overview, three of the cost analysis.

    The overview also filters plants by the carrier that serves them; the cost analysis does not. `marts` are best read
    from a published bundle, so that no order is priced again for each file.
    """
    shown = filter_shipping(marts["shipping_costs"], spec)
    served = filter_plants(marts["warehouse_costs"], spec, orders)
    plants = filter_plants(marts["warehouse_costs"], spec)
    breakdown = warehouse.cost_breakdown_export(shown, plants, map_keys=spec.map_keys)
    return [
        Export("routes_data", shipping.routes(shown), True),
        Export("storage_costs", warehouse.storage_export(served), True),
        Export("transport_mode", shipping.transport_modes(shown), True),
        Export("service_level", service.service_distribution(filter_orders(orders, spec)), True),
        Export("cost_breakdown", breakdown, False),
        Export("unit_cost_analysis", warehouse.unit_cost_quadrants(plants), False),
        Export("efficiency_matrix", warehouse.efficiency_matrix_export(plants), False),
    ]


def export_all(
    marts: Mapping[str, DataFrame],
    orders: DataFrame,
    spec: FilterSpec,
    folder: str,
    now: datetime | None = None,
    stamp: bool = False,
) -> tuple[dict[str, str], dict[str, str]]:
    """Write every export of a filter below `folder`: the places by name, and the reasons of those that were refused.

    One moment names all files. With `stamp`, each row carries that moment and the filter.
    """
    now = datetime.now() if now is None else now
    written, refused = {}, {}
    for e in exports_of(marts, orders, spec):
        frame = export.stamp_export(e.frame, spec.text(), F.lit(now)) if stamp else e.frame
        place = f"{folder}/{e.file(now)}"
        try:
            export.export_csv(frame, place) if e.guarded else export.export_csv_plain(frame, place)
            written[e.name] = place
        except export.ExportError as why:
            refused[e.name] = str(why)
    return written, refused


def export_sizes(exports: list[Export], now: datetime) -> DataFrame:
    """name, file, columns and n_rows of each export."""
    sizes = [
        e.frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(e.name).alias("name"),
            F.lit(e.file(now)).alias("file"),
            F.lit(", ".join(e.frame.columns)).alias("columns"),
            "n_rows",
        )
        for e in exports
    ]
    return reduce(DataFrame.unionAll, sizes)
