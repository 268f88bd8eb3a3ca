"""Building a version of all tables and making it the published one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from busnet.operators import publication, tiles
from busnet.plans.network import TABLES, Network
from busnet.sources.features import FeatureTables

# Tables that documents are looked up in by id are stored in the order of these columns; the later ones spread
# an id that many rows have over several files.
_LOOKUP = {
    "d_routes": ["osm_id"],
    "d_route_stop_positions": ["route_osm_id", "pos"],
    "d_route_stops_with_connections": ["route_osm_id", "stop_index", "stop_osm_type", "stop_osm_id"],
    "d_routes_ways_ids": ["rel_osm_id"],
    "d_routes_position_ids": ["rel_osm_id"],
    "i_stops": ["osm_id", "osm_type"],
    "d_stops": ["osm_id", "osm_type"],
    "d_routes_at_stop": ["osm_id", "osm_type", "rel_osm_id"],
}


class Store:
    """Versions under root/versions, and root/pointer, whose empty files name them in order: <seq>-<version>.

    A version is written completely before its file is made, so readers see either the old tables or the new ones.
    Two builders at once make two files, perhaps of one seq; the name then decides, the same for every reader, and
    neither is lost.  The version before the last stays as backup; older ones are deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root

    def _path(self, version: str, table: str) -> str:
        return f"{self._root}/versions/{version}/{table}"

    def _delete(self, path: str) -> None:
        jvm = self._spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(target, True)

    def _exists(self, path: str) -> bool:
        jvm = self._spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(target)

    def write(self, version: str, table: str, df: DataFrame) -> DataFrame:
        path = self._path(version, table)
        if order := _LOOKUP.get(table):
            # each file covers a range of its own, so a lookup by id reads one
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        df.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def _published(self) -> list[tuple[int, str]]:
        """(seq, version) in order."""
        folder = f"{self._root}/pointer"
        if not self._exists(folder):
            return []
        target = self._spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = target.getFileSystem(self._spark._jsc.hadoopConfiguration()).listStatus(target)
        names = sorted(f.getPath().getName() for f in found)
        return [(int(seq), version) for seq, _, version in (n.partition("-") for n in names) if seq.isdigit()]

    def pointer(self) -> tuple[int, str | None, str | None]:
        """(seq, current version, previous version)."""
        order = self._published()
        if not order:
            return 0, None, None
        return *order[-1], order[-2][1] if len(order) > 1 else None

    def publish(self, version: str) -> None:
        """current -> backup, version -> current; former backups go away."""
        seq = self.pointer()[0] + 1
        target = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._root}/pointer/{seq:012d}-{version}")
        target.getFileSystem(self._spark._jsc.hadoopConfiguration()).create(target, False).close()
        for _, old in self._published()[:-2]:
            self.drop_version(old)

    def drop_version(self, version: str) -> None:
        self._delete(f"{self._root}/versions/{version}")

    def drop_working_tables(self, version: str, tables: list[str]) -> None:
        for table in tables:
            self._delete(self._path(version, table))

    def table(self, name: str, backup: bool = False) -> DataFrame:
        _, current, previous = self.pointer()
        version = previous if backup else current
        if version is None:
            raise LookupError("nothing published")
        return self._spark.read.parquet(self._path(version, name))


def build_all(spark: SparkSession, features: FeatureTables, root: str) -> Store:
    """Build every table as a new version and publish it.

    Each table, and each working table that several others need, is written once and read back by what
    follows; a lost executor costs at most the stage it was working on.  A version that fails is removed.
    """
    store, version = Store(spark, root), uuid.uuid4().hex
    working: list[str] = []

    def keep(name: str, df: DataFrame) -> DataFrame:
        if name not in TABLES:
            working.append(name)
        return store.write(version, name, df)

    net = Network(features, keep)
    try:
        for name in TABLES:
            getattr(net, name)
    except BaseException:
        store.drop_version(version)
        raise
    store.drop_working_tables(version, working)
    store.publish(version)
    return store


def published_network(store: Store) -> Network:
    """A network whose tables are the published ones."""
    net = Network(features=None)
    for name in TABLES:
        setattr(net, name, store.table(name))
    net.stop_connections = net.d_route_stops_with_connections
    return net


def export_static(
    store: Store, path: str, parts: int | None = None, zooms=None, extent: tiles.Extent = tiles.WORLD
) -> None:
    """Id lists, all documents and all tiles of the published version, as files.

    Documents are spread over `parts` folders; by default one for each 20,000 of them.
    """
    net = published_network(store)
    publication.write_id_lists(net.i_stops, net.d_routes, f"{path}/ids")
    publication.write_documents(net.route_documents, ["osm_id"], f"{path}/routes", parts)
    publication.write_documents(net.stop_documents, ["osm_type", "osm_id"], f"{path}/stops", parts)
    publication.write_tiles(tiles.tile_payload(net.tile_features(zooms, extent)), f"{path}/tiles")
