"""Factor definitions, the mining plan and the registered queries."""
