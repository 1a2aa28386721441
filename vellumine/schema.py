"""Fixed schemas of the data model, as DDL (readable without a session)."""

from __future__ import annotations

PAGE = "document_id string, source string, page_number int, text string, raw_text string, ocr_text string, language string, extraction_method string, ocr_used boolean, image_count int, text_length int, raw_text_length int, ocr_quality_score double, ocr_confidence double, denoised boolean, denoising_model string, denoising_error string, denoising_corruption_ratio double, denoising_disagreement double, ocr_error string"
CHUNK = "chunk_id string, document_id string, source string, page_number int, section string, section_index int, chunk_index int, language string, extraction_method string, ocr_used boolean, denoised boolean, ocr_confidence double, denoising_model string, text string"
CITATION = "citation_id string, chunk_id string, document_id string, source string, page_number int, section string, section_index int, chunk_index int, evidence string, support_score double"
STATUS = "document_id string, filename string, storage_filename string, sha256 string, size_bytes bigint, status string, page_count int, chunk_count int, error string, created_at string, updated_at string"
QUESTION = "question string, expected_answer string, expected_pages array<int>, expected_sections array<string>"
RESPONSE = "answer string, sources array<struct<chunk_id:string,document_id:string,source:string,page_number:int,section:string>>, query string, document_id string, source_count int"
