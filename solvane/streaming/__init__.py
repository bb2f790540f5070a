"""Running statistics over append-only trial and metric logs."""
