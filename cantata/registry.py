"""Named queries over the driver tables."""
from .plans import analysis, domain, identity, melody, playing, songs, storage, streams, texts


def queries():
    return domain.queries() | analysis.QUERIES | melody.QUERIES | playing.QUERIES | texts.QUERIES | identity.QUERIES | songs.QUERIES | streams.QUERIES | storage.QUERIES


def oracle_sql():
    return domain.oracle_sql() | melody.ORACLE | playing.ORACLE | texts.ORACLE | identity.ORACLE | songs.ORACLE | streams.ORACLE | storage.ORACLE
