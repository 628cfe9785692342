"""The lead-time run (A16): seven analyses in their order, handed on as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from stowage.operators.delivery import batch_profile, combined_deliveries, delivery_behaviour
from stowage.operators.freight import analyse_freight, with_freight_cost
from stowage.operators.leadtime import prepare_stats, smart_lead_times, transport_preference, transport_stats
from stowage.session import materialised


class LeadTimes:
    """The results of one run. Each is worked out and stored when it is first asked for, so runs that share this object share its work and
    a run that needs few results pays for few: routes ask for transport, preparation and preference, arrivals for all but the routes' costs.
    """

    def __init__(
        self,
        deliveries: DataFrame,
        in_transit: DataFrame,
        vendors: DataFrame,
        charges: DataFrame,
        rates: DataFrame,
        previous: DataFrame | None = None,
        base_currency: str = "JPY",
    ):
        self._given = deliveries, in_transit
        self._vendors, self._charges, self._rates = vendors, charges, rates
        self._previous, self._base_currency = previous, base_currency

    @cached_property
    def deliveries(self) -> DataFrame:
        return materialised(self._given[0])

    @cached_property
    def in_transit(self) -> DataFrame:
        return materialised(self._given[1])

    @cached_property
    def measured(self) -> DataFrame:
        """A8 without the freight figures."""
        return materialised(transport_stats(self.deliveries, self._previous))

    @cached_property
    def freight(self) -> DataFrame:
        return materialised(analyse_freight(self._charges, self._rates, self._vendors, self._base_currency))

    @cached_property
    def transport(self) -> DataFrame:
        return with_freight_cost(self.measured, self.freight)

    @cached_property
    def prepare(self) -> DataFrame:
        return materialised(prepare_stats(self.deliveries))

    @cached_property
    def preference(self) -> DataFrame:
        return materialised(transport_preference(self.deliveries, self.measured))

    @cached_property
    def behaviour(self) -> DataFrame:
        return materialised(delivery_behaviour(combined_deliveries(self.deliveries, self.in_transit, self.measured)))

    @cached_property
    def profile(self) -> DataFrame:
        return batch_profile(self.behaviour)

    @cached_property
    def smart(self) -> DataFrame:
        """A10 over stored tables. It is not stored itself: who needs one of its seventeen columns works out that one."""
        return smart_lead_times(self.preference, self.prepare, self.measured, self._vendors)


def analyse_lead_times(
    deliveries: DataFrame,
    in_transit: DataFrame,
    vendors: DataFrame,
    charges: DataFrame,
    rates: DataFrame,
    previous: DataFrame | None = None,
    base_currency: str = "JPY",
) -> LeadTimes:
    """Transport, preparation, preference, behaviour, profile, smart lead time, freight.

    ``previous`` holds the transport statistics of the last run. The freight figures come back on
    the transport statistics as well. Deliveries, open lines and results are materialised once, when they are needed.
    """
    return LeadTimes(deliveries, in_transit, vendors, charges, rates, previous, base_currency)
