"""Order-dependent rewriting of HTML text, inside one Arrow-batched stage."""
