"""Results as documents: one text or JSON document for each key."""
