"""Nothing: the inventory has no stream operator. Plans here are batch plans over whole tables."""
