"""Knowledge-base jobs on Spark: text segmentation, hybrid retrieval, rank fusion, prompt assembly and chat history as table jobs."""
