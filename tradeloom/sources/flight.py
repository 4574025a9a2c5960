"""Named tables for Arrow clients: a catalogue, and a Flight server over it where the library is there."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

try:
    import pyarrow.flight as fl
except ImportError:  # built without it
    fl = None


class Catalogue:
    """Tables by ticket. ``swap`` puts another table in place; readers that have begun keep the old one.

    Tables are given whole to one client, so each must be a result of bounded size: ``most_rows`` refuses a larger one.
    """

    def __init__(self, most_rows: int = 1_000_000) -> None:
        self.most_rows, self.tables = most_rows, {}

    def swap(self, ticket: str, df: DataFrame) -> None:
        n = df.count()
        if n > self.most_rows:
            raise ValueError(f"{ticket}: {n} rows, more than {self.most_rows}")
        self.tables[ticket] = df.toArrow()

    def names(self) -> list[str]:
        return sorted(self.tables)

    def get(self, ticket: str) -> pa.Table:
        if ticket not in self.tables:
            raise KeyError(ticket)
        return self.tables[ticket]


def server(catalogue: Catalogue, location: str = "grpc://127.0.0.1:0"):
    """A Flight server over the catalogue; unknown tickets are errors of the kind not found."""
    if fl is None:
        raise RuntimeError("pyarrow has no Flight here")

    class Server(fl.FlightServerBase):
        def _info(self, name: str) -> fl.FlightInfo:
            t = self._table(name)
            return fl.FlightInfo(t.schema, fl.FlightDescriptor.for_path(name), [fl.FlightEndpoint(name.encode(), [])], t.num_rows, t.nbytes)

        def _table(self, name: str) -> pa.Table:
            try:
                return catalogue.get(name)
            except KeyError as e:
                raise fl.FlightServerError(f"not found: {name}") from e

        def list_flights(self, context, criteria):
            return (self._info(n) for n in catalogue.names())

        def get_flight_info(self, context, descriptor):
            return self._info(descriptor.path[0].decode())

        def do_get(self, context, ticket):
            return fl.RecordBatchStream(self._table(ticket.ticket.decode()))

    return Server(location)


def fetch(location: str, ticket: str) -> pa.Table:
    with fl.connect(location) as c:
        return c.do_get(fl.Ticket(ticket.encode())).read_all()
