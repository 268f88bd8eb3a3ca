"""Wiring of the derivations: the table DAG, publication and the registered queries."""
