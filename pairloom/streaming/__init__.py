"""Nothing here: panels are batch tables, and the engine has no streaming operators."""
