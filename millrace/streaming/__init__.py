"""Re-evaluation of rules over streams of changed documents."""
