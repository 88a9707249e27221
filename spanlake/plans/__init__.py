"""End-to-end plans (span task, pair task) and the registered query catalog."""
