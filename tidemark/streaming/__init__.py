"""Intentionally empty: the product this engine answers for is batch only.

Re-runs, load freshness and run history are its closest notions, and all of
them are batch operators (see ``operators.freshness``).
"""
