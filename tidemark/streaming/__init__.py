"""Replication between chunk stores."""
