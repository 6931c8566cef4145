"""DataFrame operators over observations, entities, streams and reports."""
