"""Schemas of method documents and of sample rows."""

INVOCATION = "struct<signature: string, resolutionMode: string, orderIndex: int>"
SIBLING = f"struct<signature: string, methodName: string, parameterTypes: array<string>, returnType: string, invocations: array<{INVOCATION}>, usedTypes: array<string>>"
METHOD = (
    "filePath string, fileContent string, classFqn string, methodSignature string, methodName string, methodBody string, bodyStartOffset int, bodyEndOffset int, "
    f"statementCount int, category string, invocations array<{INVOCATION}>, imports array<string>, classFields array<struct<name: string, typeFqn: string>>, supertypes array<string>, "
    f"siblingMethods array<{SIBLING}>, returnType string, parameterTypes array<string>, thrownExceptions array<string>, usedTypes array<string>"
)
METHOD_FIELDS = f"struct<{METHOD}>"
METRICS = (
    "struct<em: boolean, es: double, iou: double, lcs_length: int, lcs_ratio: double, lcs_no_ident_length: int, lcs_no_ident_ratio: double, gen_token_count: int, ref_token_count: int, lcs_tokens: array<string>, "
    "lcsubstring_no_ident_length: int, lcsubstring_no_ident_ratio: double, lcsubstring_no_ident_tokens: array<string>, codebleu: double, recall_at_k: double, api_coverage_at_k: double, mrr: double, retrieval_precision_at_k: double, "
    "retrieval_ndcg_at_k: double, retrieval_type_iou: double, owner_type_recall: double, compilable: boolean, compile_errors: array<string>, compile_exit_code: int>"
)
USED_CALL = "struct<order_index: int, signature: string, resolution_mode: string>"
RESULT = "struct<id: string, filePath: string, classFqn: string, signature: string, methodBody: string, methodCard: string, invocationProfile: string, typeProfile: string, score: double, rank: int, explain: string, content: string>"
TEST_EVAL = "struct<success: boolean, tests_run: int, tests_passed: int, tests_failed: int, failed_test_names: array<string>, build_success: boolean, error_messages: array<string>, duration_ms: double>"
SAMPLE = (
    "method_id string, file_path string, mode string, method_signature string, ground_truth string, generated string, normalized_ground_truth string, normalized_generated string, "
    f"metrics {METRICS}, test_eval {TEST_EVAL}, test_file_paths array<string>, direct_test_methods array<struct<test_file: string, test_class: string, test_method: string>>, coverage_ratio double, prompt string, "
    f"invocations_ordered array<{USED_CALL}>, invocations_as_used array<{USED_CALL}>, augmentation_block string, retrieval_query string, retrieval_results array<{RESULT}>, "
    f"generated_invocations array<{INVOCATION}>, line_coverage array<struct<line: int, covered: boolean, source: string>>"
)
